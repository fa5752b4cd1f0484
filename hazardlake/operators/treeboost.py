"""Gradient boosting of the Cox partial likelihood with regression trees, many fits in the same passes.

A family is (learning rate, depth, held-out fold); a fit with fewer rounds is a prefix of its
family. All families are keys of the same jobs: a round is one pass for the hazards, and one
per level of the deepest tree for histograms of the residuals by (family, node, feature, bin). The best split of a node is found
where its histogram is summed, so only one row per node comes back. Histograms are
taken in portions of bounded size.

Values are binned once on quantiles (exact where a feature has no more distinct values than
bins). A row carries its bins and one score per family; scores are written every few rounds, the
trees since then are walked.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlake.functions.gram import sum_vectors, to_numpy
from hazardlake.operators import preprocess
from hazardlake.operators.cox import MAX_TIME_CELLS, CoxProblem, check_complete
from hazardlake.session import materialize

BINS = 64
CELLS = 1 << 21  # histogram cells of one pass: 32 MB in a task
REFRESH = 10  # rounds between writings of the scores
BEST = "k long, feature int, bin int, n_left double, sum_left double, n double, total double"
NODE_COLUMNS = "family int, round int, node string, feature int, threshold double, n double, value double"


@dataclass(frozen=True)
class Family:
    rate: float
    depth: int
    held_out: int = -1


@dataclass
class BoostTree:
    """Nodes in order of growth; a value below the threshold goes left. Leaves have feature -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    n: list[float] = field(default_factory=lambda: [0.0])
    value: list[float] = field(default_factory=lambda: [0.0])
    path: list[str] = field(default_factory=lambda: [""])

    def split(self, node: int, feature: int, at: int, threshold: float, sides: Sequence[tuple[float, float]]) -> tuple[int, int]:
        made = len(self.feature)
        self.feature[node], self.bin[node], self.threshold[node] = feature, at, threshold
        self.left[node], self.right[node] = made, made + 1
        for name, (n, total) in zip("LR", sides):
            for column, v in ((self.feature, -1), (self.bin, 0), (self.threshold, 0.0), (self.left, 0), (self.right, 0), (self.n, n)):
                column.append(v)
            self.value.append(total / n)
            self.path.append(self.path[node] + name)
        return made, made + 1

    def arrays(self, on_bins: bool) -> tuple[np.ndarray, ...]:
        at = np.asarray(self.bin) + 0.5 if on_bins else np.asarray(self.threshold)
        return np.asarray(self.feature), at, np.asarray(self.left), np.asarray(self.right), np.asarray(self.value)


def walk(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """Node every row ends in."""
    feature, at, left, right, _ = tree
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while True:
        f = feature[node]
        inner = f >= 0
        if not inner.any():
            return node
        node = np.where(inner, np.where(x[rows, np.maximum(f, 0)] < at[node], left[node], right[node]), node)


def added(score: np.ndarray, x: np.ndarray, recent: Sequence[Sequence[tuple[np.ndarray, ...]]], rates: np.ndarray) -> np.ndarray:
    """Scores (rows x families) after the trees of some more rounds."""
    out = score.copy()
    for trees in recent:
        for j, t in enumerate(trees):
            out[:, j] += rates[j] * t[4][walk(t, x)]
    return out


@dataclass
class TreeBoosts:
    features: list[str]
    families: list[Family]
    rounds: list[list[BoostTree]]  # by round, then family

    def score(self, rows: DataFrame, out: str = "risk", family: int = 0) -> DataFrame:
        """Adds the summed tree predictions; ``rows`` has the array column ``x``."""
        return self.prefix_scores(rows, [len(self.rounds)], {family: None}, "_s").withColumn(out, F.get("_s", F.lit(0))).drop("_s")

    def prefix_scores(self, rows: DataFrame, prefixes: Sequence[int], families: dict[int, int | None], out: str) -> DataFrame:
        """Adds an array: for every family (in order) the score after n rounds, for every n.

        ``families``: family -> fold whose rows it scores (null for others), or None for all rows.
        """
        folds = list(families.values())
        chosen = [[t.arrays(False) for t in (trees[f] for f in families)] for trees in self.rounds]
        rates = np.array([self.families[f].rate for f in families])
        steps, sent = list(prefixes), rows.sparkSession.sparkContext.broadcast(chosen)  # trees live on the driver
        at_x, at_fold = rows.columns.index("x"), rows.columns.index("fold") if "fold" in rows.columns else None

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rb in batches:
                if not rb.num_rows:
                    continue
                x = to_numpy(rb.select([at_x]))["x"]
                s = np.full((len(x), len(folds), len(steps)), np.nan)
                score, done = np.zeros((len(x), len(folds))), 0
                for k in np.argsort(steps, kind="stable"):
                    score = added(score, x, sent.value[done : steps[k]], rates)
                    done = max(done, steps[k])
                    s[:, :, k] = score
                if at_fold is not None:
                    fold = rb.column(at_fold).to_numpy(zero_copy_only=False)
                    for j, f in enumerate(folds):
                        if f is not None:
                            s[fold != f, j] = np.nan
                flat = s.reshape(len(x), -1)
                offsets = np.arange(len(x) + 1, dtype=np.int32) * flat.shape[1]
                values = pa.array(flat.ravel(), mask=np.isnan(flat.ravel()))
                yield pa.RecordBatch.from_arrays([*rb.columns, pa.ListArray.from_arrays(pa.array(offsets), values)], names=[*rb.schema.names, out])

        return rows.mapInArrow(add, rows.withColumn(out, F.lit(None).cast("array<double>")).schema)

    def nodes(self, spark) -> DataFrame:
        """All nodes as a table; a leaf has feature -1."""
        made = [
            (j, k, t.path[i], t.feature[i], float(t.threshold[i]), float(t.n[i]), float(t.value[i]))
            for k, trees in enumerate(self.rounds) for j, t in enumerate(trees) for i in range(len(t.feature))
        ]
        return spark.createDataFrame(made, NODE_COLUMNS)


def best_of(sums: np.ndarray, counts: np.ndarray) -> tuple[int, int, float, float, float, float]:
    """Best split of a (features x bins) histogram: (feature, bin, n and sum on the left, n, sum); feature -1 if none gains."""
    n, total = counts[0].sum(), sums[0].sum()
    nl, sl = np.cumsum(counts, axis=1)[:, :-1], np.cumsum(sums, axis=1)[:, :-1]
    ok = (nl > 0) & (nl < n)
    gain = np.where(ok, sl * sl / np.where(ok, nl, 1) + (total - sl) ** 2 / np.where(ok, n - nl, 1) - total * total / max(n, 1), -1.0)
    if not gain.size or round(float(gain.max()), 6) <= 0:
        return -1, 0, 0.0, 0.0, float(n), float(total)
    f, b = divmod(int(np.argmax(np.round(gain, 6))), gain.shape[1])
    return f, b, float(nl[f, b]), float(sl[f, b]), float(n), float(total)


class Boosting:
    """Training rows and the passes over them."""

    def __init__(self, rows: DataFrame, features: Sequence[str], families: Sequence[Family], n_bins: int, max_time_cells: int):
        check_complete(rows)
        self.families, self.p, self.m = list(families), len(features), len(families)
        self.rates = np.array([f.rate for f in families])
        long = rows.select(F.posexplode("x").alias("i", "value")).select(F.col("i").cast("string").alias("feature"), "value")
        self.edges = [np.zeros(0) for _ in features]
        for r in preprocess.fit_bins(long, n_bins).collect():  # features x bins numbers
            self.edges[int(r["feature"])] = np.asarray(r["edges"], dtype=float)
        self.nb = max([1] + [len(e) + 1 for e in self.edges])
        edges, m = self.edges, self.m

        def bin_rows(batches):
            for rb in batches:
                if not rb.num_rows:
                    continue
                b = to_numpy(rb)
                bins = np.stack([np.searchsorted(e, b["x"][:, i], "right") for i, e in enumerate(edges)], axis=1)
                lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b[c]) for c in ("os", "os_time", "fold")] + [lists(bins.astype(np.int16)), lists(np.zeros((len(bins), m)))],
                    names=["os", "os_time", "fold", "bins", "x"],
                )

        fold = F.col("fold").cast("int") if "fold" in rows.columns else F.lit(-2)
        plain = rows.select(F.col("os").cast("double").alias("os"), F.col("os_time").cast("double").alias("os_time"), F.coalesce(fold, F.lit(-2)).alias("fold"), "x")
        binned = plain.mapInArrow(bin_rows, "os double, os_time double, fold int, bins array<smallint>, x array<double>")
        # the scores stand in for the columns of a Cox model with one column per family
        self.problem = CoxProblem(binned, self.m, [f.held_out for f in families], max_time_cells=max_time_cells, extra=("bins",))
        self.recent: list[list[tuple[np.ndarray, ...]]] = []

    def eta(self):
        recent, rates = self.recent, self.rates
        return lambda b: np.clip(added(b["x"], b["bins"], recent, rates), -500, 500)

    def refresh(self) -> None:
        """Write the scores with the recent trees in them."""
        eta, columns = self.eta(), self.problem.rows.columns
        place = columns.index("x")

        def run(batches):
            for rb in batches:
                if rb.num_rows:
                    s = eta(to_numpy(rb))
                    cols = list(rb.columns)
                    cols[place] = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * s.shape[1]), pa.array(s.ravel()))
                    yield pa.RecordBatch.from_arrays(cols, names=rb.schema.names)

        rows = self.problem.rows
        self.problem.rows = materialize(rows.mapInArrow(run, rows.schema))
        self.recent = []

    def best_splits(self, h0, trees: list[BoostTree], open_: Sequence[tuple[int, int]]) -> dict[tuple[int, int], tuple]:
        """Best split of every open (family, node), in portions of bounded size."""
        size = self.p * self.nb
        portion = max(1, CELLS // size)
        out = {}
        for start in range(0, len(open_), portion):
            part = open_[start : start + portion]
            for r in self._histograms(h0, trees, part).collect():  # one row per node
                out[part[r["k"]]] = tuple(r)[1:]
        return out

    def _histograms(self, h0, trees, part) -> DataFrame:
        prob, p, nb, eta = self.problem, self.p, self.nb, self.eta()
        held, times = prob.held_out, prob.times
        sent = prob.rows.sparkSession.sparkContext.broadcast(h0) if prob.on_driver else None
        rows = prob.rows if prob.on_driver else prob.rows.join(h0.withColumnRenamed("time", "os_time"), "os_time")
        flat = {j: trees[j].arrays(True) for j in {j for j, _ in part}}
        slots = {j: np.full(len(trees[j].feature), -1) for j in flat}
        for k, (j, node) in enumerate(part):
            slots[j][node] = k

        def partial(batches):
            total = np.zeros((2, len(part) * p * nb))
            for b in batches:
                bins, score = b["bins"].astype(np.int64), eta(b)
                base = sent.value[np.searchsorted(times, b["os_time"])] if sent is not None else b["h0"]
                for j, tree in flat.items():
                    slot = slots[j][walk(tree, bins)]
                    at = np.flatnonzero((slot >= 0) & (b["fold"] != held[j]))
                    if not len(at):
                        continue
                    r = b["os"][at] - np.exp(score[at, j]) * base[at, j]
                    cell = ((slot[at, None] * p + np.arange(p)) * nb + bins[at]).ravel()
                    total[0] += np.bincount(cell, np.repeat(r, p), total.shape[1])
                    total[1] += np.bincount(cell, minlength=total.shape[1])
            both = total.reshape(2, len(part), p * nb)
            seen = np.flatnonzero(both[1].any(axis=1))
            return seen, [both[:, k].ravel() for k in seen]

        def best(batches):
            for rb in batches:
                starts, values = rb.column(1).offsets.to_numpy(), rb.column(1).values.to_numpy(zero_copy_only=False)
                for i, k in enumerate(rb.column(0).to_pylist()):
                    v = values[starts[i] : starts[i + 1]].reshape(2, p, nb)
                    yield pa.RecordBatch.from_pylist([dict(zip(("k", "feature", "bin", "n_left", "sum_left", "n", "total"), (k, *best_of(v[0], v[1]))))], schema=kinds)

        kinds = pa.schema([("k", pa.int64()), ("feature", pa.int32()), ("bin", pa.int32())] + [(c, pa.float64()) for c in ("n_left", "sum_left", "n", "total")])
        return sum_vectors(rows, partial).mapInArrow(best, BEST)

    def grow_round(self) -> list[BoostTree]:
        """One tree for every family."""
        _, h0 = self.problem.hazards_of(self.eta())
        trees = [BoostTree() for _ in self.families]
        open_ = [(j, 0) for j in range(self.m)]
        for level in range(max(f.depth for f in self.families)):
            nxt = []
            for (j, node), (f, at, n_left, sum_left, n, total) in self.best_splits(h0, trees, open_).items():
                if node == 0:
                    trees[j].n[0], trees[j].value[0] = n, total / max(n, 1)
                if f >= 0:
                    made = trees[j].split(node, f, at, float(self.edges[f][at]), [(n_left, sum_left), (n - n_left, total - sum_left)])
                    if level + 1 < self.families[j].depth:
                        nxt += [(j, c) for c in made]
            open_ = sorted(nxt)
            if not open_:
                break
        self.recent.append([t.arrays(True) for t in trees])
        if len(self.recent) == REFRESH:
            self.refresh()
        return trees


def fit_families(
    rows: DataFrame, features: Sequence[str], families: Sequence[Family], rounds: int = 100, n_bins: int = BINS, max_time_cells: int = MAX_TIME_CELLS
) -> TreeBoosts:
    """All families on ``(os, os_time, x[, fold])`` for ``rounds`` rounds.

    The number of jobs is rounds x (1 + deepest depth) and does not depend on the number of families. Trees stay on the
    driver, 2**depth nodes at most each.
    """
    if any(f.depth < 1 for f in families):
        raise ValueError("trees have a depth of at least 1")
    boosting = Boosting(rows, features, families, n_bins, max_time_cells)
    return TreeBoosts(list(features), list(families), [boosting.grow_round() for _ in range(rounds)])


def fit_tree_boost(rows: DataFrame, features: Sequence[str], n_estimators: int = 100, rate: float = 0.8, max_depth: int = 3, n_bins: int = BINS) -> TreeBoosts:
    """One fit: regression trees on martingale residuals, added with a learning rate."""
    return fit_families(rows, features, [Family(rate, max_depth)], n_estimators, n_bins)
