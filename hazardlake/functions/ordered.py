"""Order-dependent building blocks that never sort a whole group in one task.

Ranks, running totals and exact quantiles are all two-level: rows fall into
value ranges (or hash ranges), each range is ordered on its own, and a small
table with one row per range carries the offsets.  A key that owns a third of
the table is therefore spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardlake.session import keep, materialize

_BOUNDS = 1023  # value ranges per group minus one; a power of two minus one
_SAMPLE_EVERY = 1024  # one distinct value in this many may become a boundary
_SAMPLE_SLOTS = 8192  # most candidates one group can have, whatever its size
_BROADCAST_GROUPS = 4096  # groups whose boundaries (8 KB each at most) are sent to every task
_BROADCAST_RANGES = 200_000  # single ranges sent to every task


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_int(text: str | Column, digits: int = 15) -> Column:
    """First hex digits of md5 as an integer; equal in any SQL engine."""
    return F.conv(F.substring(F.md5(as_col(text)), 1, digits), 16, 10).cast("bigint")


def seeded_text(seed: str | int | Column, id_col: str | Column) -> Column:
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.concat(seed.cast("string"), F.lit(":"), as_col(id_col).cast("string"))


def join_null_safe(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; ``right`` adds its other columns."""
    cols = list(cols)
    named = right.select(*[F.col(c).alias(f"_k{cols.index(c)}") if c in cols else F.col(c) for c in right.columns])
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(cols)]
    return left.join(named, on, how).drop(*[f"_k{i}" for i in range(len(cols))])


def count_at_most(bounds: Column, value: Column, most: int | None = None) -> Column:
    """How many entries of a sorted array are <= value, by binary search.

    The halving steps follow the size of the array, so any length works. Where the caller
    knows that no array has more than ``most`` entries, they are made once, not for every row.
    """
    if most is None:
        top = F.greatest(F.floor(F.log2(F.greatest(F.size(bounds), F.lit(1)))), F.lit(0)).cast("int")
        steps = F.transform(F.sequence(top, F.lit(0)), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    else:
        steps = F.array(*[F.lit(1 << k) for k in range(max(1, most).bit_length() - 1, -1, -1)])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda acc, s: F.when(F.get(bounds, acc + s - 1) <= value, acc + s).otherwise(acc),
    )


def hash_rank(
    df: DataFrame,
    id_col: str,
    seed: str | int | Column,
    keys: Sequence[str] = (),
    rank_col: str = "rank",
    total_col: str | None = None,
    digits: int = 4,
) -> DataFrame:
    """1-based position of every row in md5(seed:id) order inside ``keys``.

    The first hex digits split each group into up to 16**digits even ranges.
    ``id_col`` must be unique inside ``keys``. Null keys form a group of their
    own and a null id gets a rank like any other: every row comes back once.
    """
    keys = list(keys)
    code = F.md5(F.coalesce(seeded_text(seed, id_col), F.lit("null")))
    ranged = df.withColumn("_range", F.conv(F.substring(code, 1, digits), 16, 10).cast("int"))
    offsets = _offsets(
        ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n")), keys, "_range", ["_n"], total_col is not None
    )
    # the hash is made again behind the shuffle, which carries a number in its place
    w = Window.partitionBy(*keys, "_range").orderBy("_row", "_h", id_col)
    met = _with_offsets(ranged, offsets, keys).withColumn("_h", code)
    ends = {rank_col: F.first("_before_n").over(w) + F.row_number().over(w) - 1}
    if total_col:
        ends[total_col] = F.first("_total_n").over(w)
    return met.withColumns(ends).filter("_row").drop("_h", "_row", "_range", "_before_n", "_total_n")


def _with_offsets(ranged: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt by (keys, _range), led by the offsets of their range as a row with ``_row`` false.

    One shuffle brings both together; null keys meet as in any grouping.
    """
    own = [c for c in offsets.columns if c not in keys and c != "_range"]
    kinds = {f.name: f.dataType for f in offsets.schema}
    rows = ranged.select("*", F.lit(True).alias("_row"), *[F.lit(None).cast(kinds[c]).alias(c) for c in own])
    empty = [F.col(f.name) if f.name in keys or f.name == "_range" else F.lit(None).cast(f.dataType).alias(f.name) for f in ranged.schema]
    heads = offsets.select(*empty, F.lit(False).alias("_row"), *own)
    return rows.union(heads).repartition(*keys, "_range")


def _offsets(totals: DataFrame, keys: list[str], range_col: str, cols: list[str], with_total: bool = True) -> DataFrame:
    """Per range: what lies in the ranges before it, and the group total.

    The input holds one row per (group, range), so its windows are bounded.
    """
    before = Window.partitionBy(*keys).orderBy(range_col).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    out = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before{c}") for c in cols]
    if with_total:
        out += [F.sum(c).over(whole).alias(f"_total{c}") for c in cols]
    return totals.select(*keys, range_col, *out)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order_col: str,
    sums: Sequence[str],
    sample_every: int = _SAMPLE_EVERY,
) -> DataFrame:
    """Add ``<c>_upto`` (inclusive running sum) and ``<c>_all`` (group total).

    ``df`` holds one row per (keys, order_col), which callers get by
    aggregating first.  Suffix sums follow as ``_all - _upto + c``.  Range
    boundaries are a hash-chosen subset of the group's own values, so they are
    the same however often Spark evaluates the plan.  The choice is made inside
    an aggregate that reads every column: the exchange under ``df`` then has one
    shape for all three uses and is computed once.
    """
    keys, sums = list(keys), list(sums)
    ranged = _ranged(df, keys, order_col, _boundaries(df, keys, order_col, sums, sample_every))
    offsets = _offsets(ranged.groupBy(*keys, "_range").agg(*[F.sum(c).alias(c) for c in sums]), keys, "_range", sums)
    w = Window.partitionBy(*keys, "_range").orderBy("_row", order_col).rowsBetween(Window.unboundedPreceding, 0)
    met = _with_offsets(ranged, offsets, keys)
    out = {f"{c}_upto": F.sum(c).over(w) + F.first(f"_before{c}").over(w) for c in sums} | {f"{c}_all": F.first(f"_total{c}").over(w) for c in sums}
    return met.select("*", *[v.alias(c) for c, v in out.items()]).filter("_row").select(*df.columns, *out)


def _boundaries(df: DataFrame, keys: list[str], order_col: str, sums: list[str], sample_every: int = _SAMPLE_EVERY) -> DataFrame:
    """``(keys, _bounds)``: where the value ranges of every group begin."""
    h = F.xxhash64(F.col(order_col))
    chosen = F.pmod(h, F.lit(sample_every)) == 0
    slot = F.when(chosen, F.pmod(F.shiftright(h, 20), F.lit(_SAMPLE_SLOTS)))
    carried = [F.max(c).alias(f"_m{i}") for i, c in enumerate(sums)]
    candidates = df.groupBy(*keys, slot.alias("_slot")).agg(F.min_by(order_col, h).alias("v"), *carried)
    item = F.struct("v", *[f"_m{i}" for i in range(len(sums))])
    listed = candidates.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("_slot").isNotNull(), item))).alias("_vals")
    )
    n = F.least(F.size("_vals"), F.lit(_BOUNDS))
    return listed.select(
        *keys,
        F.when(
            n > 0,
            F.transform(
                F.sequence(F.lit(0), n - 1),
                lambda i: F.get(F.col("_vals"), (i * F.size("_vals") / n).cast("int"))["v"],
            ),
        ).alias("_bounds"),
    )


def _ranged(df: DataFrame, keys: list[str], order_col: str, bounds: DataFrame) -> DataFrame:
    """Rows with the number of their value range as ``_range``."""
    if keys:
        ranged = join_null_safe(df, bounds, keys)
    else:
        ranged = df.withColumn("_bounds", bounds.scalar())
    return ranged.withColumn(
        "_range", F.when(F.col("_bounds").isNull(), 0).otherwise(count_at_most(F.col("_bounds"), F.col(order_col), _BOUNDS))
    ).drop("_bounds")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    weight: str | Column | None = None,
    out: str = "quantiles",
) -> DataFrame:
    """Exact linear-interpolation quantiles per group as one array column.

    Works on value counts, so no group is ever held in one task's memory. Only
    value ranges that hold a wanted position are put in order.
    """
    keys = list(keys)
    w = F.lit(1) if weight is None else as_col(weight)
    counts = keep(
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.sum(w).cast("bigint").alias("_c"))
    )
    # the wanted positions, floor and ceiling of p * (n - 1), ascend with p
    levels = sorted({float(p) for p in probs})
    wanted = F.array(*[F.lit(p) for p in levels])
    pos = lambda i: F.get(wanted, i) * (F.col("_total_c") - 1)
    steps = [1 << k for k in range(len(levels).bit_length() - 1, -1, -1)]

    def below(passed):
        """How many wanted positions pass a test that holds for a first part of them, by binary search."""
        return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda acc, s: F.when(passed(pos(acc + s - 1)), acc + s).otherwise(acc))

    def held(start, end):
        """Indices of the floors (first) and ceilings that lie from ``start`` to before ``end``."""
        floors = [below(lambda x, b=b: x < b) for b in (start, end)]
        ceils = [below(lambda x, b=b: x <= b - 1) for b in (start, end)]
        return floors, ceils

    bounds = materialize(_boundaries(counts, keys, "_v", ["_c"]))
    few = bounds.limit(_BROADCAST_GROUPS + 1).count() <= _BROADCAST_GROUPS
    ranged = _ranged(counts, keys, "_v", F.broadcast(bounds) if few and keys else bounds)
    sizes = ranged.groupBy(*keys, "_range").agg(F.sum("_c").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_range"))  # one row per range
    sizes = sizes.select(*keys, "_range", (upto - F.col("_c")).alias("_before_c"), upto.alias("_end"), F.sum("_c").over(Window.partitionBy(*keys)).alias("_total_c"))
    floors, ceils = held(F.col("_before_c"), F.col("_end"))
    offsets = materialize(sizes.filter((floors[1] > floors[0]) | (ceils[1] > ceils[0])).drop("_end"))
    few = offsets.limit(_BROADCAST_RANGES + 1).count() <= _BROADCAST_RANGES
    near = join_null_safe(ranged, F.broadcast(offsets) if few else offsets, [*keys, "_range"])
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    run = near.withColumn("_upto", upto + F.col("_before_c"))
    floors, ceils = held(F.col("_upto") - F.col("_c"), F.col("_upto"))
    run = run.withColumns({"_f0": floors[0], "_f1": floors[1], "_c0": ceils[0], "_c1": ceils[1]})
    # position 2i is the floor of level i, 2i + 1 its ceiling
    some = lambda a, b, side: F.when(F.col(b) > F.col(a), F.transform(F.sequence(F.col(a), F.col(b) - 1), lambda i: 2 * i + side)).otherwise(F.array().cast("array<int>"))
    hits = run.filter("_f1 > _f0 OR _c1 > _c0").withColumn("_i", F.explode(F.concat(some("_f0", "_f1", 0), some("_c0", "_c1", 1))))
    # two entries per probability
    found = hits.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("_i", F.col("_v").cast("double").alias("v")))).alias("_f"),
        F.max("_total_c").alias("_total_c"),
    )

    def item(i):
        lo, hi, where = F.get("_f", 2 * i)["v"], F.get("_f", 2 * i + 1)["v"], pos(i)
        return lo + (hi - lo) * (where - F.floor(where))

    places = F.array(*[F.lit(levels.index(float(p))) for p in probs])
    return found.select(*keys, F.transform(places, item).alias(out))


def average_ranks(counts: DataFrame, keys: Sequence[str], value: str, count: str) -> DataFrame:
    """Tie-averaged ascending rank of every distinct value, from value counts."""
    run = running_totals(counts, keys, value, [count])
    return run.select(
        *keys,
        value,
        count,
        (F.col(f"{count}_upto") - (F.col(count) - 1) / 2.0).alias("avg_rank"),
        F.col(f"{count}_all").alias("n"),
    )
