"""Harrell's concordance index without pairwise joins.

A pair (i, j) is comparable when i has an event and j lies strictly later in
the order (time, event before censored).  Equal rows are counted once as cells.
Cells are cut along time and along risk into ranges of about ``CHUNK`` cells;
the value at a cut is a range of its own.  The two cells of a pair then lie in
the same time range (counted by sorting in one task), in different time ranges
but the same range of risks (counted in that range's task), or in different
ranges of both (counted on a grid of sums).  Cells of one crowded time or risk
need no task, so every row is shuffled twice after counting whatever the
number of ranges, and no task sees a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlake.functions.ordered import count_at_most, join_null_safe
from hazardlake.session import keep

CHUNK = 1 << 17
MAX_RANGES = 1 << 10  # cuts of one group along each axis; its grid has at most 3 x 2 times their square
MAX_BROADCAST_GROUPS = 100_000
_SAMPLED = 64  # cells behind one cut


def count_dominated(order: np.ndarray, risk: np.ndarray, event: np.ndarray, weight: np.ndarray) -> tuple[int, int]:
    """Weighted pairs with order_i < order_j, event_i: (risk_j < risk_i, risk_j = risk_i).

    Rows are visited in risk order; the bits of the time rank split them into
    earlier and later halves, one bit per pass.  After each pass the earlier
    halves move before the later ones, which keeps the rows of a node together.
    """
    u = np.unique(order, return_inverse=True)[1].astype(np.int32)
    r = np.unique(risk, return_inverse=True)[1].astype(np.int32)
    by_risk = np.argsort(r, kind="stable")
    u, r, ev, w = u[by_risk], r[by_risk], (event * weight)[by_risk].astype(np.int64), weight[by_risk].astype(np.int64)
    below = equal = 0
    bits = int(u.max()).bit_length() if len(u) else 0
    for b in range(bits - 1, -1, -1):
        late = (u >> b) & 1 == 1
        node = u >> (b + 1)
        cum = np.concatenate([[0], np.cumsum(np.where(late, w, 0))])
        new_node = np.concatenate([[True], node[1:] != node[:-1]])
        starts = np.flatnonzero(new_node | np.concatenate([[True], r[1:] != r[:-1]]))
        early = np.add.reduceat(np.where(late, 0, ev), starts)  # per node and risk
        node_starts = np.flatnonzero(new_node)
        first = node_starts[np.searchsorted(node_starts, starts, "right") - 1]
        below += int(np.sum(early * (cum[starts] - cum[first])))
        equal += int(np.sum(early * (cum[np.append(starts[1:], len(u))] - cum[starts])))
        u, r, ev, w = (np.concatenate([x[~late], x[late]]) for x in (u, r, ev, w))
    return below, equal


def _comparable(order: np.ndarray, event: np.ndarray, weight: np.ndarray) -> int:
    """Weighted pairs with order_i < order_j, event_i."""
    u = np.unique(order, return_inverse=True)[1]
    n = int(u.max()) + 1
    events = np.bincount(u[event == 1], weight[event == 1], n).astype(np.int64)
    rows = np.bincount(u, weight, n).astype(np.int64)
    return int(np.sum(events * (rows.sum() - np.cumsum(rows))))


def _counted(g: int, concordant: int, tied: int, comparable: int) -> pa.Table:
    return pa.table({"_g": [g], "concordant": [concordant], "tied": [tied], "comparable": [comparable]}, _COUNTED)


_COUNTED = pa.schema([(c, pa.int64()) for c in ("_g", "concordant", "tied", "comparable")])
_COUNTED_SQL = "_g bigint, concordant bigint, tied bigint, comparable bigint"


def _range_pairs(table: pa.Table) -> pa.Table:
    """Pairs inside one range of times (``_axis`` 0) or, between times ranges, inside one range of risks."""
    n = lambda c: table.column(c).to_numpy()
    at, risk, signed = n("_at"), n("_r"), n("_w")
    event, weight = (signed > 0).astype(np.int64), np.abs(signed)
    g, along_time = table.column("_g")[0].as_py(), table.column("_axis")[0].as_py() == 0
    # at one time events precede those censored there
    order = 2 * np.unique(at, return_inverse=True)[1] + (1 - event) if along_time else at
    return _counted(g, *count_dominated(order, risk, event, weight), _comparable(order, event, weight) if along_time else 0)


def _grid_pairs(table: pa.Table) -> pa.Table:
    """Pairs between time ranges, other than those inside one open range of risks."""
    n = lambda c: table.column(c).to_numpy()
    t = np.unique(n("_tc"), return_inverse=True)[1]
    values, r = np.unique(n("_rc"), return_inverse=True)
    m = np.zeros((int(t.max()) + 1, len(values)), dtype=np.int64)
    np.add.at(m, (t, r), n("_m"))
    later = m.sum(axis=0) - np.cumsum(m, axis=0)  # rows of the risk range in later time ranges
    lower = np.cumsum(later, axis=1) - later
    d = n("_d")
    alone = values[r] % 2 == 1  # ranges of one risk
    return _counted(
        table.column("_g")[0].as_py(), int(np.sum(d * lower[t, r])), int(np.sum(np.where(alone, d * later[t, r], 0))),
        int(np.sum(d * later.sum(axis=1)[t])),
    )


def _placed(cells: DataFrame, groups: DataFrame, keys: list[str], n_groups: int) -> DataFrame:
    """Cells with the numbers of their time range and risk range.

    Times: 3c between cuts, 3c + 1 for events and 3c + 2 for censored rows at a cut.  Risks: 2c between cuts, 2c + 1 at one.
    """
    cuts = groups.select(*keys, "_g", "_tb", "_rb")
    cuts = F.broadcast(cuts) if n_groups <= MAX_BROADCAST_GROUPS else cuts
    j = join_null_safe(cells, cuts, keys) if keys else cells.crossJoin(cuts)
    j = j.filter("_e IS NOT NULL").withColumns({"_c": count_at_most(F.col("_tb"), F.col("_t")), "_k": count_at_most(F.col("_rb"), F.col("_r"))})
    at_cut = lambda cuts, c, v: F.coalesce(F.get(cuts, F.col(c) - 1) == F.col(v), F.lit(False))
    tc = F.when(at_cut("_tb", "_c", "_t"), 3 * F.col("_c") - 1 - (F.col("_e") == 1).cast("int")).otherwise(3 * F.col("_c"))
    rc = F.when(at_cut("_rb", "_k", "_r"), 2 * F.col("_k") - 1).otherwise(2 * F.col("_k"))
    return j.select("_g", tc.alias("_tc"), rc.alias("_rc"), "_t", "_e", "_r", "_n", (F.size("_tb") > 0).alias("_cut"))


def concordance_index(
    df: DataFrame, event: str, time: str, risk: str, keys: Sequence[str] = (), chunk: int = CHUNK
) -> DataFrame:
    """``(keys, concordant, tied, comparable, left_out, cindex)``; NULL index without comparable pairs.

    Higher risk should mean an earlier event; equal risks count one half. Rows
    without event, time or risk cannot be compared: ``left_out`` counts them.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(event).cast("int").alias("_e"), F.col(time).cast("double").alias("_t"), F.col(risk).cast("double").alias("_r"))
    whole = F.col("_e").isNotNull() & F.col("_t").isNotNull() & F.col("_r").isNotNull()
    rows = rows.select(*keys, *[F.when(whole, F.col(c)).alias(c) for c in ("_e", "_t", "_r")])
    cells = keep(rows.groupBy(*keys, "_e", "_t", "_r").agg(F.count(F.lit(1)).alias("_n")))

    # cuts are values of cells chosen by hash, one of every few, so that a range has about ``chunk`` cells
    each = min(_SAMPLED, chunk)
    chosen = F.pmod(F.xxhash64("_e", "_t", "_r"), F.lit(max(1, chunk // each))) == 0
    none = F.col("_e").isNull()
    listed = lambda c: F.sort_array(F.collect_list(F.when(chosen & ~none, F.col(c))))
    groups = cells.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(none, F.col("_n"))), F.lit(0)).cast("bigint").alias("left_out"), listed("_t").alias("_tb"), listed("_r").alias("_rb")
    )
    step = F.greatest(F.lit(each), F.ceil(F.size("_tb") / MAX_RANGES).cast("int"))
    cut = lambda c: F.array_distinct(F.filter(c, lambda _, i: i % step == step - 1))
    groups = keep(groups.select(*keys, "left_out", F.monotonically_increasing_id().alias("_g"), cut("_tb").alias("_tb"), cut("_rb").alias("_rb")))
    n_groups, several = groups.agg(F.count(F.lit(1)), F.max(F.size("_tb"))).first()
    placed = _placed(cells, groups, keys, n_groups)
    if several:
        placed = keep(placed)

    signed = F.when(F.col("_e") == 1, F.col("_n")).otherwise(-F.col("_n"))
    axis = lambda i, c, at: F.struct(F.lit(i).alias("_axis"), F.col(c).cast("long").alias("_range"), F.col(at).cast("double").alias("_at"))
    in_time = F.when(F.col("_tc") % 3 == 0, axis(0, "_tc", "_t"))
    in_risk = F.when(F.col("_cut") & (F.col("_rc") % 2 == 0), axis(1, "_rc", "_tc"))
    dealt = placed.select("_g", F.explode(F.filter(F.array(in_time, in_risk), lambda x: x.isNotNull())).alias("_x"), "_r", signed.alias("_w"))
    dealt = dealt.select("_g", "_x._axis", "_x._range", "_x._at", "_r", "_w")
    counts = dealt.groupBy("_g", "_axis", "_range").applyInArrow(_range_pairs, _COUNTED_SQL)
    if several:
        d = F.sum(F.when(F.col("_e") == 1, F.col("_n")).otherwise(0)).alias("_d")
        grid = placed.filter("_cut").groupBy("_g", "_tc", "_rc").agg(d, F.sum("_n").alias("_m"))
        counts = counts.unionByName(grid.groupBy("_g").applyInArrow(_grid_pairs, _COUNTED_SQL))
    names = ("concordant", "tied", "comparable")
    total = counts.groupBy("_g").agg(*[F.sum(c).alias(c) for c in names])
    total = groups.select(*keys, "_g", "left_out").join(total, "_g", "left")
    total = total.select(*keys, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in names], "left_out")
    c, s, n = F.col("concordant"), F.col("tied"), F.col("comparable")
    return total.withColumn("cindex", F.when(n > 0, (c + 0.5 * s) / n))


def concordance_td(
    df: DataFrame, event: str, time: str, curve: str, grid: Sequence[float], keys: Sequence[str] = (), chunk: int = CHUNK
) -> DataFrame:
    """Time-dependent concordance: S_i(t_i) < S_j(t_i) over comparable pairs.

    ``curve`` holds each row's survival at the ascending times of ``grid``;
    beyond a grid point the next one applies (the last one for later times).
    Events are taken grid step by grid step: inside a step all curves are read
    at one point, so the step is an ordinary concordance in which rows of later
    steps take part as partners only.
    """
    steps = F.array(*[F.lit(float(g)) for g in grid])
    last = len(grid) - 1
    own = F.least(F.size(F.filter(steps, lambda g: g < F.col(time))), F.lit(last))
    rows = df.withColumn("_own", own)
    # a row is a partner in every step up to its own
    seen = rows.withColumn("_step", F.explode(F.sequence(F.lit(0), F.col("_own"))))
    in_step = F.col("_step") == F.col("_own")
    beyond = F.lit(float("inf"))
    cast = seen.select(
        *keys, "_step",
        F.when(in_step, F.col(event)).otherwise(0).alias("_ev"),
        F.when(in_step, F.col(time)).otherwise(beyond).alias("_at"),
        (-F.get(F.col(curve), F.col("_step"))).alias("_rk"),
    )
    c = concordance_index(cast, "_ev", "_at", "_rk", [*keys, "_step"], chunk)
    sums = [F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("concordant", "tied", "comparable")]
    out = c.groupBy(*keys).agg(*sums)
    n = F.col("comparable")
    return out.withColumn("cindex", F.when(n > 0, (F.col("concordant") + 0.5 * F.col("tied")) / n))
