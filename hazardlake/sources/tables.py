"""Reading sample tables and cohort tables; run seeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hazardlake.functions.ordered import seeded_text
from hazardlake.operators.schema import drop_unnamed


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A wide sample table from CSV or parquet, without leftover index columns.

    A schema spares CSV readers a pass over the data.
    """
    if ".csv" in path:
        reader = spark.read.option("header", True)
        df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    elif ".parquet" in path:
        df = spark.read.parquet(path)
    else:
        raise ValueError("Unsupported file format")
    return drop_unnamed(df)


def read_cohorts(cohorts: DataFrame, labels: Sequence[str], label_col: str = "cohort") -> DataFrame:
    """The cohort table restricted to the labels in use."""
    return cohorts.filter(F.col(label_col).isin(list(labels)))


def draw_seeds(spark: SparkSession, num_runs: int, master: int | str = 0) -> DataFrame:
    """``(run, seed)``: distinct seeds from 1..999 in md5(master:seed) order."""
    if not 1 <= num_runs <= 999:
        raise ValueError("between 1 and 999 runs")
    from pyspark.sql import Window

    pool = spark.range(1, 1000).select(F.col("id").cast("int").alias("seed"))
    order = Window.orderBy(F.md5(seeded_text(str(master), "seed")), "seed")  # 999 rows
    return pool.select(F.row_number().over(order).cast("int").alias("run"), "seed").filter(F.col("run") <= num_runs)
