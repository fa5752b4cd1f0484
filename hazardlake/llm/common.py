"""Helpers shared by the text operators."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlake.session import staging_path

# fixed values: the white space and word patterns of the query contracts
SPACES = r"[\x20\x09-\x0D]+"
NON_SPACES = r"[^\x20\x09-\x0D]+"


# texts and bytes of one Arrow batch; by default there are ten times as many texts, of any length
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: computed once, safe when executors are lost.

    Long texts go to Python in small batches while this runs.
    """
    spark = df.sparkSession
    path, before = staging_path(spark, name), {key: spark.conf.get(key) for key in BATCH}
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions the session works with."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def power_of_two(n: int) -> int:
    return 1 << max(0, int(n - 1).bit_length())


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def all_same(left: DataFrame, right: DataFrame, cols: list[str]) -> Column:
    """Null-safe equality on several columns, usable as an equi-join."""
    return functools.reduce(lambda x, y: x & y, [left[c].eqNullSafe(right[c]) for c in cols])


def join_same(left: DataFrame, right: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null equals null; the key columns appear once."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in cols else F.col(c) for c in right.columns])
    cond = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in cols])
    return left.join(r, cond, how).drop(*[f"_r_{c}" for c in cols])


SENT_ROWS = 500_000  # rows of a few dozen bytes: some tens of megabytes


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it has few rows, otherwise left to Spark."""
    return F.broadcast(df) if df.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df


def drop_rows(docs: DataFrame, found: DataFrame, id_col: str, key: Column) -> DataFrame:
    """``docs`` without the rows that ``found`` (id, _kn: key, kept) does not keep.

    Text is not shuffled while few rows go. Of rows that repeat id and key one stays.
    """
    named = found.groupBy(F.col(id_col).alias("_kid"), "_kn").agg(F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_times"))
    named = stage(named.filter("NOT _kept OR _times > 1"), "not-kept")
    keyed = join_same(docs.withColumns({"_kid": F.col(id_col), "_kn": key}), small(named), ["_kid", "_kn"], "left")
    kept = keyed.filter("_kept IS NULL")
    repeated = keyed.filter("_kept").dropDuplicates(["_kid", "_kn"])
    # rows without a key are never dropped: each stands for itself
    return kept.unionByName(repeated).select(*docs.columns)


def arrow_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string or binary column and its offsets; null is empty."""
    import pyarrow as pa

    if pa.types.is_string(col.type):
        col = col.cast(pa.large_string())
    elif pa.types.is_binary(col.type):
        col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null("" if pa.types.is_large_string(col.type) else b"")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, a fixed bijection on 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pieces(offsets: np.ndarray, most: int):
    """Cut rows into consecutive groups of about ``most`` bytes; a row is never cut."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, end
        start = end
