"""Permutation importance and the importance table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardlake.functions.ordered import hash_rank
from hazardlake.operators.concordance import concordance_index
from hazardlake.session import materialize


def permuted_columns(df: DataFrame, features: Sequence[str], n_iter: int = 15, seed=0, id_col: str = "row_id") -> DataFrame:
    """``(feature, iter, id, own, permuted)``: every feature's values shuffled over rows.

    Row at position k of one random order takes the value of the row at
    position k of another.
    """
    reps = F.explode(F.sequence(F.lit(0), F.lit(n_iter - 1))).alias("iter")
    long = df.select(id_col, *[F.col(f).cast("double").alias(f) for f in features]).unpivot([id_col], list(features), "feature", "own")
    long = long.select(id_col, "feature", "own", reps)
    keys = ["feature", "iter"]
    text = lambda side: F.concat_ws(":", F.lit(f"{seed}:{side}"), F.col("feature"), F.col("iter").cast("string"))
    to = hash_rank(long, id_col, text("to"), keys, "_k")
    frm = hash_rank(long.withColumnRenamed("own", "permuted"), id_col, text("from"), keys, "_k").drop(id_col)
    return to.hint("merge").join(frm, [*keys, "_k"]).drop("_k")


def permutation_importance(
    df: DataFrame,
    features: Sequence[str],
    coefficients: dict[str, float] | None = None,
    score: Callable[[DataFrame], DataFrame] | None = None,
    n_iter: int = 15,
    seed=0,
    id_col: str = "row_id",
    risk: str = "risk",
) -> DataFrame:
    """Mean and population sd of the C-index drop when a feature is shuffled.

    A linear model only needs risk + b * (x_permuted - x).  Any other model is
    given as ``score``: a function from rows with all feature columns to the
    same rows with a ``risk`` column; the rows of all features and iterations
    go through it in one pass.
    """
    rows = materialize(df.select(id_col, "os", "os_time", risk, *features))
    base = concordance_index(rows, "os", "os_time", risk).first()["cindex"]
    perm = permuted_columns(rows, features, n_iter, seed, id_col)
    if coefficients is not None:
        b = F.create_map(*[c for f in features for c in (F.lit(f), F.lit(float(coefficients[f])))])[F.col("feature")]
        moved = perm.join(rows.select(id_col, "os", "os_time", risk), id_col).withColumn(
            "risk", F.col(risk) + b * (F.col("permuted") - F.col("own"))
        )
    else:
        if score is None:
            raise ValueError("give the coefficients of a linear model or a score function")
        wide = perm.join(rows, id_col)
        for f in features:
            wide = wide.withColumn(f, F.when(F.col("feature") == f, F.col("permuted")).otherwise(F.col(f)))
        moved = score(wide.drop(risk))
    c = concordance_index(moved, "os", "os_time", "risk", ["feature", "iter"])
    drop = F.lit(base) - F.col("cindex")
    return c.groupBy("feature").agg(F.avg(drop).alias("importance"), F.stddev_pop(drop).alias("importance_sd"))


def importance_table(importances: DataFrame, model: str, test: float, val: float, train: float) -> DataFrame:
    """Importances with the model's three C-indices and tie-averaged descending rank.

    Its windows cover one row per feature.
    """
    w = Window.orderBy(F.col("importance").desc())
    ties = F.count(F.lit(1)).over(Window.partitionBy("importance"))
    rank = F.rank().over(w) + (ties - 1) / 2.0
    return importances.select(
        "feature", "importance", "importance_sd", F.lit(model).alias("model"), F.lit(test).alias("test_cindex"),
        F.lit(val).alias("val_cindex"), F.lit(train).alias("train_cindex"), rank.alias("rank"),
    )
