"""URL rules behind a blocked Bloom filter.

The listed (host, path) rules are canonical keys. A url has one candidate key per
host suffix and listed path length. All keys of a url fall into filter blocks of
512 bits, eight bits per key; a candidate that misses one bit is no rule. Those
that pass meet the rule table in an exact hash join, which removes the false
positives, and the longest rule wins.

The filter is bounded by ``filter_bytes``, so it can be sent to every task; with
more rules it passes more candidates and stays right. Urls are judged once per
distinct value.

Cases: a null url, or one without ``://``, has empty host and path; the empty
host fits only rules with an empty host; repeated pages each get a row; an empty
page table gives an empty result, an empty rule table the default verdict; among
rules of one length the smaller (host, path) wins; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlake.llm.common import power_of_two

BLOCK_BITS, PROBES = 512, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def probes(h: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of every key and its eight bit positions inside."""
    h = h.view(np.uint64)
    block = (h >> np.uint64(40)) % np.uint64(n_blocks)
    step = ((h >> np.uint64(9)) | np.uint64(1)) & np.uint64(BLOCK_BITS - 1)
    bits = (h[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(BLOCK_BITS)
    return block.astype(np.int64), bits.astype(np.int64)


def build_filter(rules: DataFrame, filter_bytes: int) -> np.ndarray:
    """The filter as a bit array of blocks: tasks emit their set bits, equal ones are merged."""
    n = rules.count()
    n_blocks = min(power_of_two(-(-n * 16 // BLOCK_BITS)), filter_bytes * 8 // BLOCK_BITS)

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            block, bit = probes(b["h"].to_numpy(np.int64), n_blocks)
            at = np.unique((block[:, None] * BLOCK_BITS + bit).ravel())
            word, mask = at // 64, np.left_shift(np.uint64(1), (at % 64).astype(np.uint64)).view(np.int64)
            yield pd.DataFrame({"word": word, "mask": mask})

    words = rules.select(F.xxhash64("host", "path").alias("h")).mapInPandas(bits, "word long, mask long")
    # at most filter_bytes / 8 rows come back
    rows = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    made = np.zeros(n_blocks * BLOCK_BITS // 64, np.uint64)
    made[rows["word"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).view(np.uint64)
    return made


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    filter_bytes: int = 32 << 20,
) -> DataFrame:
    """id, host, path, rule, verdict. ``rules`` has host, path and verdict."""
    spark = pages.sparkSession
    rules = rules.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    # a null url has an empty host and path, like an empty one
    url = F.coalesce(F.col(url_col), F.lit(""))
    urls = pages.select(url.alias("url")).distinct().withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    # lengths of paths: no more values than characters in the longest path
    lengths = [r[0] for r in rules.select(F.length("path").alias("n")).distinct().collect()]
    sent = spark.sparkContext.broadcast(build_filter(rules, filter_bytes))

    @F.pandas_udf("boolean")
    def may_be_listed(h: pd.Series) -> pd.Series:
        words = sent.value
        block, bit = probes(h.to_numpy(np.int64), len(words) * 64 // BLOCK_BITS)
        at = block[:, None] * BLOCK_BITS + bit
        return pd.Series(((words[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)).all(axis=1))

    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts) - i + 1)))
    keys = urls.select("url", "path", F.explode(suffixes).alias("rule_host"))
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    keys = keys.select("url", "rule_host", F.explode(F.transform(fits, lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("rule_path"))
    passed = keys.filter(may_be_listed(F.xxhash64("rule_host", "rule_path")))
    hits = passed.join(rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict"), ["rule_host", "rule_path"])
    name = F.concat("rule_host", "rule_path")
    best = hits.groupBy("url").agg(F.min(F.struct((-F.length(name)).alias("n"), "rule_host", "rule_path", name.alias("rule"), "verdict")).alias("best"))
    out = pages.select(F.col(id_col).alias("_id"), url.alias("url")).join(best, "url", "left")
    return out.select(
        F.col("_id").alias(id_col),
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
