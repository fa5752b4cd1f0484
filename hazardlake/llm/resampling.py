"""Target-distribution importance resampling with Arrow kernels.

Features are runs of one to ``order`` (1 or 2) words in hashed buckets. Bucket counts
of the raw corpus and of the target texts give a gain per bucket; a document's weight
is the mean gain of its features; Gumbel noise from a hash of its id turns the ``share``
highest scores into a draw without replacement that reruns repeat.

In tasks, Arrow does the text work: ``ascii_lower``, ``split_pattern_regex``,
``list_flatten`` and ``dictionary_encode``. Word pairs are shifted dictionary
indices; only distinct words and pairs are hashed, a pair by going on from the checksum
of its first word. Buckets and gains come back by ``take`` and are summed per document
as differences of a running sum. Batches are cut by bytes, a text is never cut.

Every task returns at most one count per bucket, so what is gathered is bounded by
buckets, not rows. Ranks need no sort of the corpus: a histogram of scores (whole numbers
in a range that does not depend on the number of rows) gives the cut and every score's
offset; rows of one score are ordered among themselves.

Cases: null or wordless text has no features, weight 0 and is never drawn; a null id hashes
as an empty one; equal scores go to the smaller id (null last), rows that repeat
an id in an order fixed by their content; an empty corpus gives an empty result, empty target texts
a gain from the smoothing alone; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardlake.llm.common import pieces, stage

# fixed values: what stands between the contract's words, letters lowered, as UTF-8
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
PIECE = 4 << 20  # bytes of text worked on at once


def cut(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about ``PIECE`` bytes of an Arrow text column, each with its first row."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for a, b in pieces(np.append(0, np.cumsum(sizes)), PIECE):
        yield a, column.slice(a, b - a)


def feature_buckets(text: pa.Array, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every feature, text of every feature, words of every text); texts ascend within words and within pairs."""
    # a slice is copied first: lowering goes wrong on offsets that do not begin at 0
    text = pc.fill_null(text.take(pa.array(np.arange(len(text)))), "")
    lists = pc.split_pattern_regex(pc.ascii_lower(text), pattern=BETWEEN)
    words, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    there = pc.greater(pc.binary_length(words), 0)
    coded = pc.dictionary_encode(words.filter(there))
    owner = parent.filter(there).to_numpy(zero_copy_only=False).astype(np.int64)
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    known = [w.encode() for w in coded.dictionary.to_pylist()]
    single = np.fromiter(map(crc32, known), np.int64, len(known))
    # shifted indices: neighbours inside one text
    both = owner[1:] == owner[:-1]
    pair = (index[:-1] * max(1, len(known)) + index[1:])[both]
    distinct, back = np.unique(pair, return_inverse=True)
    first, second = np.divmod(distinct, max(1, len(known)))
    begun = [crc32(b" ", int(c)) for c in single]
    double = np.fromiter((crc32(known[b], begun[a]) for a, b in zip(first.tolist(), second.tolist())), np.int64, len(distinct))
    buckets = np.concatenate([(single % n_buckets).take(index), (double % n_buckets).take(back)])
    return buckets, np.concatenate([owner, owner[1:][both]]), np.bincount(owner, minlength=len(text)).astype(np.int64)


def bucket_counts(df: DataFrame, text_col: str, n_buckets: int) -> np.ndarray:
    """Features per bucket over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for _, text in cut(batch.column(0)):
                total += np.bincount(feature_buckets(text, n_buckets)[0], minlength=n_buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": at, "n": total[at]})

    counted = df.select(text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    made = np.zeros(n_buckets, np.int64)
    for r in counted.collect():  # at most n_buckets rows
        made[r.bucket] = r.n
    return made


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the smoothed log ratio of target to raw shares, rounded down."""
    n, s, t = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((int(b) + 1) * (s + n) / ((int(a) + 1) * (t + n)))) for a, b in zip(raw, target)], np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """doc, h, n_words, n_features, weight."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, text in cut(batch.column(2)):
                buckets, owner, n_words = feature_buckets(text, len(gains))
                got = np.zeros((2, len(text)), np.int64)
                cuts = [0, int(n_words.sum()), len(owner)]
                for lo, hi in zip(cuts, cuts[1:]):  # words, then pairs: texts ascend in each
                    upto = np.append(0, np.cumsum(gains.take(buckets[lo:hi])))
                    ends = np.searchsorted(owner[lo:hi], np.arange(len(text) + 1))
                    got += np.stack([np.diff(ends), np.diff(upto[ends])])
                n, total = got
                weight = np.where(n > 0, np.floor_divide(total, np.maximum(n, 1)), 0)
                kept = [batch.column(i).slice(a, len(text)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, (n_words, n, weight))], names=["doc", "h", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(weigh, f"doc {kind}, h long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    percent: int = 25,
    least_words: int = 20,
    seed: int = 7,
    n_buckets: int = BUCKETS,
) -> DataFrame:
    """One row per document: id, n_features, weight, score, rank (null if not drawn)."""
    gains = bucket_gains(bucket_counts(docs, text_col, n_buckets), bucket_counts(target, target_col, n_buckets))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = weighted(docs, gains, id_col, text_col).withColumn("score", F.col("weight") + noise)
    rows = stage(rows.withColumn("able", F.col("n_words") >= least_words), "resampling-scores")

    # one row per score: whole numbers from logarithms, some ten thousands however many rows there are
    levels = rows.filter("able").groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0))
    drawn = F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100)
    levels = levels.select(F.col("score").alias("level"), (upto - F.col("n")).alias("before"), drawn.alias("drawn")).filter("before < drawn")
    placed = rows.join(levels, F.col("able") & (F.col("score") == F.col("level")), "left")
    inside = F.row_number().over(Window.partitionBy("level").orderBy(F.asc_nulls_last("doc"), "h"))
    place = placed.filter("level IS NOT NULL").withColumn("rank", (F.col("before") + inside).cast("bigint"))
    place = place.withColumn("rank", F.when(F.col("rank") <= F.col("drawn"), F.col("rank")))
    none = placed.filter("level IS NULL").withColumn("rank", F.lit(None).cast("bigint"))
    return place.unionByName(none).select(F.col("doc").alias(id_col), "n_features", "weight", "score", "rank")
