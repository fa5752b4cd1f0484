"""Entropy, mutual information and greedy feature selection on binned data.

Two layouts are used.  ``long``: ``(keys, row_id, feature, bin)``.  ``packed``:
one row per (run, row_id) with an array of bins in feature order, the target
``y`` and a weight ``w``.  In the packed layout a selected feature's bin is an
array lookup on the same row, so a greedy step needs no join: it explodes the
array and aggregates to a table of feature x bin x bin x target cells, most of
it before the shuffle.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from hazardlake.functions.ordered import average_ranks, hash_rank
from hazardlake.session import materialize

TIE_DIGITS = 10  # scores equal to this many decimals are ties; the first column wins
MAX_EDGE_BYTES = 512 << 20  # largest table of bin edges that is broadcast


def entropies(joint: DataFrame, keys: Sequence[str], variables: Sequence[str], count: str = "c") -> DataFrame:
    """Entropy in bits of every non-empty subset of ``variables``.

    Columns ``h_<names joined by _>`` and ``n``.  One grouping-sets aggregate
    over the joint counts gives all marginals.
    """
    keys, variables = list(keys), list(variables)
    subsets = [s for r in range(1, len(variables) + 1) for s in itertools.combinations(variables, r)]
    sets = [[F.col(k) for k in keys] + [F.col(v) for v in s] for s in subsets]
    cols = [F.col(k) for k in keys] + [F.col(v) for v in variables]
    cells = joint.groupingSets(sets, *cols).agg(F.sum(count).cast("double").alias("_c"), F.grouping_id().alias("_g"))
    code = {s: sum(1 << (len(variables) - 1 - i) for i, v in enumerate(variables) if v not in s) for s in subsets}
    clogc = F.col("_c") * F.log2("_c")
    aggs = [F.sum(F.when(F.col("_g") == code[s], clogc)).alias("l_" + "_".join(s)) for s in subsets]
    n = F.sum(F.when(F.col("_g") == 0, F.col("_c"))).alias("n")
    sums = cells.filter(F.col("_c") > 0).groupBy(*keys).agg(n, *aggs)
    hs = [
        F.greatest(F.log2("n") - F.col("l_" + "_".join(s)) / F.col("n"), F.lit(0.0)).alias("h_" + "_".join(s))
        for s in subsets
    ]
    return sums.select(*keys, "n", *hs)


def discrete_entropy(long: DataFrame, keys: Sequence[str] = ("feature",), value: str = "bin") -> DataFrame:
    counts = long.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    h = entropies(counts, keys, [value])
    return h.select(*keys, F.col(f"h_{value}").alias("entropy"))


def joint_counts(
    long: DataFrame, target: DataFrame, keys: Sequence[str] = ("feature",), id_col: str = "row_id",
    y: str = "y", weight: str | None = None,
) -> DataFrame:
    """``(keys, x, y, c)`` from long bins and a per-row target."""
    w = F.lit(1) if weight is None else F.col(weight)
    joined = long.join(target, id_col).filter(F.col("bin").isNotNull() & F.col(y).isNotNull())
    return joined.groupBy(*keys, F.col("bin").alias("x"), F.col(y).alias("y")).agg(F.sum(w).alias("c"))


def mutual_information(joint: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """I(x;y), both entropies, H(x|y) and symmetrical uncertainty per key."""
    h = entropies(joint, keys, ["x", "y"])
    mi = F.greatest(F.col("h_x") + F.col("h_y") - F.col("h_x_y"), F.lit(0.0))
    both = F.col("h_x") + F.col("h_y")
    return h.select(
        *keys,
        F.col("h_x").alias("entropy_x"),
        F.col("h_y").alias("entropy_y"),
        mi.alias("mi"),
        (F.col("h_x_y") - F.col("h_y")).alias("cond_entropy"),
        F.when(both > 0, 2 * mi / both).otherwise(0.0).alias("su"),
    )


def conditional_mi(joint: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """I(x;s|y) from joint counts ``(keys, x, s, y, c)``."""
    h = entropies(joint, keys, ["x", "s", "y"])
    cmi = F.col("h_s_y") + F.col("h_x_y") - F.col("h_x_s_y") - F.col("h_y")
    return h.select(*keys, F.greatest(cmi, F.lit(0.0)).alias("cmi"))


# ---- packed layout ----------------------------------------------------------

def pack_bins(
    vectors: DataFrame, edges: DataFrame, features: Sequence[str], keys: Sequence[str] = (), n_keys: int = 1,
    n_bins: int = 10, x: str = "x", out: str = "bins",
) -> DataFrame:
    """Replace the value array by the array of its bins, without a shuffle of rows.

    ``edges`` is the fitted table ``([keys], feature, edges)``.  Its size is
    known beforehand: keys x features x bins doubles, held by every task, which
    bins one column of a batch at a time.
    """
    if n_keys * len(features) * n_bins * 8 > MAX_EDGE_BYTES:
        raise ValueError("bin edges too large to send to every task; bin fewer runs or features per call")
    keys, spark = list(keys), vectors.sparkSession
    place = {f: i for i, f in enumerate(features)}
    fitted = edges.select(*keys, "feature", "edges").collect()
    slots = list(dict.fromkeys(tuple(r[k] for k in keys) for r in fitted))
    slot_of = {k: i for i, k in enumerate(slots)}
    table: list[list] = [[np.zeros(0)] * len(features) for _ in slots]
    for r in fitted:
        if r["feature"] in place:
            table[slot_of[tuple(r[k] for k in keys)]][place[r["feature"]]] = np.array(r["edges"] or [], dtype=float)
    sent = spark.sparkContext.broadcast(table)
    if keys:
        types = {f.name: f.dataType for f in edges.schema}
        schema = StructType([StructField(k, types[k]) for k in keys] + [StructField("_slot", IntegerType())])
        numbered = spark.createDataFrame([(*k, i) for k, i in slot_of.items()], schema)
        rows = vectors.join(F.broadcast(numbered), keys)
    else:
        rows = vectors.withColumn("_slot", F.lit(0))
    rest = [c for c in rows.columns if c not in (x, "_slot")]
    made = rows.select(*rest).withColumn(out, F.lit(None).cast("array<int>")).schema

    def binned(batches):
        for b in batches:
            if not b.num_rows:
                continue
            col, slot = b.column(x), b.column("_slot").to_numpy(zero_copy_only=False)
            flat = col.flatten()
            empty = flat.is_null().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            values = flat.to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            bins = np.zeros(values.shape, dtype=np.int32)
            for s in np.unique(slot):
                mine = np.flatnonzero(slot == s)
                for i, e in enumerate(sent.value[s] if sent.value else []):
                    bins[mine, i] = np.searchsorted(e, values[mine, i], side="right")
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * values.shape[1]
            packed = pa.ListArray.from_arrays(pa.array(ends), pa.array(bins.ravel(), mask=empty.ravel()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], packed], names=[*rest, out])

    return rows.select(*rest, x, "_slot").mapInArrow(binned, made)


@dataclass(frozen=True)
class Rule:
    """How a greedy step scores a candidate f given the selected set S.

    ``linear``: I(f;y) - beta * sum I(fj;f) + gamma * sum I(fj;f|y)
    ``worst``:  I(f;y) - max over fj of [I(fj;f) - I(fj;f|y)], floored or not
    ``ratio``:  sum over fj of I(f,fj;y) / H(f,fj,y)
    """

    kind: str
    beta: float | None = 0.0
    gamma: float | None = 0.0
    floor: float = -math.inf
    stop_at_zero: bool = False


RULES: dict[str, Rule] = {
    "MIM": Rule("linear", 0.0, 0.0),
    "MIFS": Rule("linear", 0.5, 0.0),
    "MRMR": Rule("linear", None, 0.0),
    "JMI": Rule("linear", None, None),
    "CIFE": Rule("linear", 1.0, 1.0),
    "CMIM": Rule("worst", stop_at_zero=True),
    "ICAP": Rule("worst", floor=0.0, stop_at_zero=True),
    "DISR": Rule("ratio", stop_at_zero=True),
}


def _cells(packed: DataFrame, keys: list[str], groups: Sequence[int], picks: Mapping | None, key_values: list) -> DataFrame:
    """Joint counts per feature position, with the picked bin when given."""
    group_of = F.array(*[F.lit(int(g)) for g in groups])
    base = packed.select(*keys, "y", "w", "bins")
    if picks is not None:
        # picks: key tuple -> list of positions, one per group (bounded by runs x modalities)
        if keys:
            table = F.create_map(
                *itertools.chain(*[(F.lit(k), F.array(*[F.lit(int(p)) for p in picks[k]])) for k in key_values])
            )
            chosen = table[F.col(keys[0])]
        else:
            chosen = F.array(*[F.lit(int(p)) for p in picks[None]])
        base = base.withColumn("_chosen", F.transform(chosen, lambda p: F.get(F.col("bins"), p)))
        rows = base.select(*keys, "y", "w", "_chosen", F.posexplode("bins").alias("pos", "x"))
        rows = rows.withColumn("s", F.get(F.col("_chosen"), F.get(group_of, F.col("pos"))))
        rows = rows.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("s").isNotNull())
        return rows.groupBy(*keys, "pos", "x", "s", "y").agg(F.sum("w").alias("c"))
    rows = base.select(*keys, "y", "w", F.posexplode("bins").alias("pos", "x"))
    rows = rows.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    return rows.groupBy(*keys, "pos", "x", "y").agg(F.sum("w").alias("c"))


def greedy_select(
    packed: DataFrame,
    features: Sequence[str],
    method: str = "JMI",
    k: int | None = 50,
    groups: Sequence[int] | None = None,
    run_col: str | None = None,
    beta: float | None = None,
    y: str = "y",
    allowed: Mapping[int, Sequence[int]] | None = None,
) -> list[dict]:
    """Greedy selection for all runs and feature groups at once.

    ``allowed`` narrows the candidate positions of single runs.

    ``groups[i]`` is the group (modality) of feature i; every group of every run
    picks up to ``k`` features of its own.  Each step is one job whose result
    has runs x features rows; only those statistics reach the driver.
    """
    if method not in RULES:
        raise ValueError(f"unknown selection method: {method}")
    rule = RULES[method]
    if beta is not None and rule.kind == "linear":
        rule = Rule("linear", beta, rule.gamma)
    p = len(features)
    groups = [0] * p if groups is None else list(groups)
    g_ids = np.asarray(groups)
    n_groups = int(g_ids.max()) + 1 if p else 0
    keys = [run_col] if run_col else []
    work = packed.select(*keys, F.col(y).alias("y"), (F.col("w") if "w" in packed.columns else F.lit(1)).alias("w"), "bins")

    t1: dict = {}
    first = entropies(_cells(work, keys, groups, None, []), [*keys, "pos"], ["x", "y"])
    for r in first.select(*keys, "pos", (F.col("h_x") + F.col("h_y") - F.col("h_x_y")).alias("mi")).collect():
        t1.setdefault(r[run_col] if run_col else None, np.full(p, -np.inf))[r["pos"]] = max(r["mi"], 0.0)
    for run, keep in (allowed or {}).items():
        out_of = np.setdiff1d(np.arange(p), np.asarray(list(keep), dtype=int))
        if run in t1:
            t1[run][out_of] = -np.inf
    runs = sorted(t1, key=lambda v: (v is None, v))
    state = {
        run: {"t2": np.zeros(p), "t3": np.zeros(p), "worst": np.full(p, rule.floor), "ratio": np.zeros(p)} for run in runs
    }
    out: list[dict] = []
    chosen: dict = {(run, g): [] for run in runs for g in range(n_groups)}
    active = set(chosen)

    def take(run, g, scores):
        """Best unselected candidate of the group; lowest position among ties."""
        free = np.flatnonzero((g_ids == g) & np.isfinite(t1[run]))
        free = free[~np.isin(free, chosen[run, g])]
        if not len(free):
            return None
        s = np.round(scores[free], TIE_DIGITS)
        i = int(free[int(np.argmax(s))])
        chosen[run, g].append(i)
        out.append(
            {"run": run, "group": g, "rank": len(chosen[run, g]), "feature": features[i], "pos": i,
             "score": float(scores[i]), "mi": float(t1[run][i])}
        )
        return float(scores[i])

    for run, g in sorted(active, key=str):
        if take(run, g, t1[run]) is None or k == 1:
            active.discard((run, g))
    if rule.kind == "linear" and rule.beta == 0.0 and rule.gamma == 0.0:
        # scores never change, so the rest follows from the first job
        while active:
            for run, g in sorted(active, key=str):
                score = take(run, g, t1[run])
                if score is None or len(chosen[run, g]) == k or (k is None and score < 0):
                    active.discard((run, g))
        return out

    while active:
        last = {run: [(chosen[run, g] or [0])[-1] for g in range(n_groups)] for run in runs}
        h = entropies(_cells(work, keys, groups, last, runs), [*keys, "pos"], ["x", "s", "y"])
        redundancy = F.col("h_x") + F.col("h_s") - F.col("h_x_s")
        given_y = F.col("h_s_y") + F.col("h_x_y") - F.col("h_x_s_y") - F.col("h_y")
        pair_info = F.col("h_x_s") + F.col("h_y") - F.col("h_x_s_y")
        stats = h.select(*keys, "pos", redundancy.alias("r"), given_y.alias("g"), pair_info.alias("pi"), F.col("h_x_s_y").alias("h")).collect()
        for r in stats:
            s = state[r[run_col] if run_col else None]
            i = r["pos"]
            s["t2"][i] += r["r"]
            s["t3"][i] += r["g"]
            s["worst"][i] = max(s["worst"][i], r["r"] - r["g"])
            s["ratio"][i] += r["pi"] / r["h"] if r["h"] > 0 else 0.0
        for run, g in sorted(active, key=str):
            s, n_sel = state[run], len(chosen[run, g])
            if rule.kind == "linear":
                b = 1.0 / n_sel if rule.beta is None else rule.beta
                c = 1.0 / n_sel if rule.gamma is None else rule.gamma
                scores = t1[run] - b * s["t2"] + c * s["t3"]
            elif rule.kind == "worst":
                scores = t1[run] - s["worst"]
            else:
                scores = s["ratio"]
            score = take(run, g, scores)
            done = score is None or len(chosen[run, g]) == k
            if k is None and score is not None:
                done = done or (score <= 0 if rule.stop_at_zero else score < 0)
            if done:
                active.discard((run, g))
    return out


def selection_table(spark, picks: list[dict], run_col: str | None = None) -> DataFrame:
    rows = [(str(p["run"]) if run_col else None, p["group"], p["rank"], p["feature"], p["score"], p["mi"]) for p in picks]
    df = spark.createDataFrame(rows, "run string, group int, rank int, feature string, score double, mi double")
    if run_col:
        return df.withColumn("run", F.col("run").cast("int"))
    return df.drop("run")


def top_by_mi(mi: DataFrame, dictionary: DataFrame, k: int) -> DataFrame:
    """Univariate ranking as one lazy plan: ``(feature, mi, rank)``."""
    key = F.round("mi", TIE_DIGITS)
    best = mi.join(dictionary.select("feature", "pos"), "feature").orderBy(key.desc(), F.col("pos")).limit(k)
    from pyspark.sql import Window

    w = Window.orderBy(key.desc(), F.col("pos"))  # at most k rows
    return best.select("feature", "mi", F.row_number().over(w).alias("rank"))


def fcbf(packed: DataFrame, features: Sequence[str], delta: float = 0.0, y: str = "y") -> list[dict]:
    """Relevance by symmetrical uncertainty, then removal of redundant features.

    Features with SU(f;y) > delta are taken best first; a taken feature removes
    every remaining f with SU(f; taken) >= SU(f;y).  One job per taken feature.
    """
    work = packed.select(F.col(y).alias("y"), (F.col("w") if "w" in packed.columns else F.lit(1)).alias("w"), "bins")
    one = [0] * len(features)
    both = F.col("h_x") + F.col("h_y")
    su = F.when(both > 0, 2 * (both - F.col("h_x_y")) / both).otherwise(0.0)
    rel = entropies(_cells(work, [], one, None, []), ["pos"], ["x", "y"]).select("pos", su.alias("su"))
    relevance = {r["pos"]: r["su"] for r in rel.collect()}
    left = sorted((i for i in relevance if relevance[i] > delta), key=lambda i: (-round(relevance[i], TIE_DIGITS), i))
    out = []
    while left:
        top = left.pop(0)
        out.append({"feature": features[top], "rank": len(out) + 1, "su": relevance[top]})
        if not left:
            break
        both_s = F.col("h_x") + F.col("h_s")
        su_s = F.when(both_s > 0, 2 * (both_s - F.col("h_x_s")) / both_s).otherwise(0.0)
        h = entropies(_cells(work, [], one, {None: [top]}, []), ["pos"], ["x", "s"])
        to_top = {r["pos"]: r["su"] for r in h.select("pos", su_s.alias("su")).collect()}
        left = [i for i in left if round(to_top.get(i, 0.0), TIE_DIGITS) < round(relevance[i], TIE_DIGITS)]
    return out


# ---- rank correlation -------------------------------------------------------

def spearman(joint: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Spearman's rho per key from joint counts ``(keys, x, y, c)``.

    Ranks come from value counts; the rows themselves are never sorted.  A
    constant side gives NULL.
    """
    keys = list(keys)
    joint = materialize(joint)
    rx = average_ranks(joint.groupBy(*keys, "x").agg(F.sum("c").alias("cx")), keys, "x", "cx")
    ry = average_ranks(joint.groupBy(*keys, "y").agg(F.sum("c").alias("cy")), keys, "y", "cy")
    j = joint.join(rx.select(*keys, "x", F.col("avg_rank").alias("rx"), "n"), [*keys, "x"]).join(
        ry.select(*keys, "y", F.col("avg_rank").alias("ry")), [*keys, "y"]
    )
    mid = (F.col("n") + 1) / 2.0
    dx, dy, c = F.col("rx") - mid, F.col("ry") - mid, F.col("c")
    s = j.groupBy(*keys).agg(F.sum(c * dx * dy).alias("xy"), F.sum(c * dx * dx).alias("xx"), F.sum(c * dy * dy).alias("yy"))
    rho = F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))
    return s.select(*keys, rho.alias("rho"))


def top_by_rank_correlation(rho: DataFrame, dictionary: DataFrame, k: int) -> DataFrame:
    """Features by |rho|, undefined ones last, ties in column order."""
    from pyspark.sql import Window

    key = F.round(F.abs("rho"), TIE_DIGITS).desc_nulls_last()
    best = rho.join(dictionary.select("feature", "pos"), "feature").orderBy(key, "pos").limit(k)
    return best.select("feature", "rho", F.row_number().over(Window.orderBy(key, "pos")).alias("rank"))


# ---- permutation null -------------------------------------------------------

def permuted_pairs(df: DataFrame, id_col: str, x: str, y: str, n_perm: int = 200, seed=0, given: str | None = None) -> DataFrame:
    """Joint counts ``(perm, x, y[, s], c)`` with x shuffled over the rows."""
    cols = [y] + ([given] if given else [])
    perms = F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("perm")
    text = lambda side: F.concat(F.lit(f"{seed}:{side}:"), F.col("perm").cast("string"))
    xs = hash_rank(df.select(perms, id_col, F.col(x).alias("x")), id_col, text("x"), ["perm"], "_k").drop(id_col)
    ys = hash_rank(df.select(perms, id_col, *cols), id_col, text("y"), ["perm"], "_k").drop(id_col)
    j = xs.hint("merge").join(ys, ["perm", "_k"])
    by = ["perm", "x", F.col(y).alias("y")] + ([F.col(given).alias("s")] if given else [])
    return j.groupBy(*by).agg(F.count(F.lit(1)).alias("c"))


def permutation_interval(values: DataFrame, measure: str, n_perm: int, ci: float = 0.95) -> DataFrame:
    """Mean and interval ends of one measure per permutation (n_perm rows)."""
    s = values.agg(F.avg(measure).alias("mean"), F.sort_array(F.collect_list(measure)).alias("_all"))
    lo, hi = int((1.0 - ci) / 2 * n_perm), int((1.0 + ci) / 2 * n_perm)
    return s.select("mean", F.get("_all", F.lit(lo)).alias("lower"), F.get("_all", F.lit(hi)).alias("upper"))
