"""Exact dedup: a tree of merged digest runs.

Documents are dealt by id into runs. A run is the sorted list of its digests,
each with the smallest identifier and the number of rows. In every round
``fan_in`` neighbouring runs are merged: entries with one digest become one
entry that keeps the smaller identifier. A copy group with a third of all rows
is therefore one entry per run after the first step, and at most ``fan_in``
entries meet in one merge. The result walks back down: the root's answer is
joined to the runs, then to the rows, by (run, digest), so the hot digest stays
spread over the runs.

An entry is merged only if a second, independent hash and the length agree as
well as the SHA-256 digest.

Cases: null text counts as empty; rows without id come after all others (a
group with no id at all has keep_id null); of rows that repeat both id and text
one is kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardlake.llm.common import SPACES, drop_rows, parallelism, power_of_two, stage

KEY = ["text_sha256", "_check", "_length"]


def normalised(text: Column) -> Column:
    """Every stretch of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def with_digests(df: DataFrame, text: Column) -> DataFrame:
    clean = df.withColumn("_clean", normalised(text))
    return clean.withColumns(
        {"text_sha256": F.sha2("_clean", 256), "_check": F.xxhash64("_clean"), "_length": F.length("_clean")}
    ).drop("_clean")


def merged(runs: DataFrame) -> DataFrame:
    return runs.groupBy("_run", *KEY).agg(F.min("_first").alias("_first"), F.sum("_n").alias("_n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    n_runs = power_of_two(parallelism(docs.sparkSession))
    rows = with_digests(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), F.col("_text")).drop("_text")
    rows = rows.withColumn("_run", F.pmod(F.xxhash64("_id"), F.lit(n_runs)).cast("int"))
    rows = stage(rows.sortWithinPartitions("_run", *KEY, "_id"), "digest-runs")

    # nulls sort last among identifiers
    first = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"))
    leaves = rows.groupBy("_run", *KEY).agg(F.min(first).alias("_first"), F.count(F.lit(1)).alias("_n"))
    root, left = leaves, n_runs
    while left > 1:
        root = merged(root.withColumn("_run", F.floor(F.col("_run") / fan_in).cast("int")))
        left = -(-left // fan_in)
    top = root.select(*KEY, F.col("_first.id").alias("keep_id"), F.col("_n").alias("group_size"))
    answers = leaves.select("_run", *KEY).join(top, KEY)
    placed = rows.join(answers, ["_run", *KEY])
    again = F.row_number().over(Window.partitionBy("_run", *KEY, "_id").orderBy(F.lit(0)))
    return placed.withColumn("_again", again).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_again") == 1)).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    found = stage(exact_dedup(docs, id_col, text_col), "kept").withColumnRenamed("text_sha256", "_kn")
    return drop_rows(docs, found, id_col, F.sha2(normalised(F.col(text_col)), 256))
