"""Result tables of repeated runs, written as partitioned parquet."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from hazardlake.operators.ensemble import fusion_tables
from hazardlake.sources.tables import draw_seeds


WRITERS = 32  # files one task keeps open; with more partitions it sorts its rows instead
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def _write_parts(df: DataFrame, path: str) -> None:
    """Partitioned by run and split; tasks with few of them write their rows as they come, without a sort."""
    conf = df.sparkSession.conf
    before = conf.get(_WRITERS, None)
    conf.set(_WRITERS, str(WRITERS))
    try:
        # row groups of 32 MB, as a task buffers one per open file
        df.write.mode("overwrite").option("parquet.block.size", str(32 << 20)).partitionBy("run", "split").parquet(path)
    finally:
        conf.unset(_WRITERS) if before is None else conf.set(_WRITERS, before)


def write_splits(df: DataFrame, path: str) -> None:
    """Selected features of all splits, partitioned by run and split."""
    _write_parts(df, path)


def write_predictions(pred: DataFrame, path: str) -> None:
    _write_parts(pred, path)


def write_selected_features(selected: DataFrame, path: str) -> None:
    """``(run, feature, rank)``; runs may differ in length."""
    selected.select("run", "feature", "rank").write.mode("overwrite").parquet(path)


def write_performance(cidx: DataFrame, models: Sequence[str], path: str, keys: Sequence[str] = ("run", "split", "types", "subset")) -> None:
    """C-index table, one row per run, split and subset, one column per model."""
    keys = [k for k in keys if k in cidx.columns]
    cidx.groupBy(*keys).pivot("model", list(models)).agg(F.first("cindex")).write.mode("overwrite").parquet(path)


def write_fusion_summary(summary: DataFrame, models: Sequence[str], path: str) -> None:
    for value in ("mean", "ci95"):
        fusion_tables(summary, models, value).write.mode("overwrite").parquet(f"{path}/{value}")


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def run_seeds(spark: SparkSession, path: str, num_runs: int, master=0) -> DataFrame:
    """Seeds of the runs, drawn once and reused from ``path`` afterwards."""
    if read_if_present(spark, path) is None:
        draw_seeds(spark, num_runs, master).write.parquet(path)
    return spark.read.parquet(path)


class Store:
    """Tables of finished steps under one folder.

    A step writes its tables to a folder of its own attempt, and one manifest row (key, attempt, tables) last. A
    step counts as finished only through that row, so one that was cut off in its middle, or in the middle
    of its writing, is done again and its leftovers are never read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def finished(self) -> dict[str, tuple[str, list[str]]]:
        """key -> (attempt, tables), one row per step; of two attempts at one step the same is taken by every reader."""
        rows = read_if_present(self.spark, f"{self.path}/manifest")
        if rows is None:
            return {}
        first = rows.groupBy("key").agg(F.min(F.struct("attempt", "tables")).alias("m"))
        return {r["key"]: (r["m"]["attempt"], list(r["m"]["tables"])) for r in first.collect()}

    def get(self, key: str, done: dict | None = None) -> dict[str, DataFrame] | None:
        """Tables of a finished step, or None."""
        found = (self.finished() if done is None else done).get(key)
        if found is None:
            return None
        attempt, names = found
        return {n: self.spark.read.parquet(f"{self.path}/data/{attempt}/{n}") for n in names}

    def put(self, key: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Write the tables of a step, then its manifest row; returns them as stored."""
        attempt = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/data/{attempt}/{name}")
        row = self.spark.createDataFrame([(key, attempt, sorted(tables))], "key string, attempt string, tables array<string>")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return self.get(key, {key: (attempt, sorted(tables))})

    def step(self, key: str, compute: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
        """Stored tables of a step, computed if it is not finished."""
        found = self.get(key)
        return self.put(key, compute()) if found is None else found


def checkpoint_runs(
    spark: SparkSession, path: str, runs: DataFrame, compute: Callable[[DataFrame], DataFrame], archive: str | None = None
) -> DataFrame:
    """Results per run, computing only the runs that are not finished yet.

    ``runs`` holds ``run`` (and what ``compute`` needs); ``archive`` names the
    stored result of another experiment to take instead of computing. Runs that are computed together
    are finished together, with the manifest row of `Store`.
    """
    store = Store(spark, path if archive is None else archive)
    if archive is None:
        done = {int(r) for key in store.finished() for r in key.split(",")}
        todo = runs.filter(~F.col("run").isin(sorted(done))) if done else runs
        wanted = sorted(r["run"] for r in todo.select("run").distinct().collect())  # one number per run
        if wanted:
            store.put(",".join(map(str, wanted)), {"result": compute(todo)})
    finished = store.finished()
    parts = [store.get(key, finished)["result"] for key in sorted(finished)]
    if not parts:
        raise ValueError(f"no finished run under {store.path}")
    return functools.reduce(lambda a, b: a.unionByName(b), parts)
