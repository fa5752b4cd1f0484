"""Imputation, scaling and discretisation on the long form.

Each step is ``fit`` (one row per feature, from training rows) and ``apply``
(a join on the feature name).  A fitted table has at most one row per feature
column of the input, a number known from the schema, so it is broadcast up to
``MAX_BROADCAST_FEATURES`` rows and left to Spark's own join choice beyond.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlake.functions.ordered import count_at_most, exact_quantiles, running_totals

MAX_BROADCAST_FEATURES = 200_000
IMPUTE_MODES = ("drop", "zeroes", "median", "mean", "mode", None)
SCALERS = ("standardize", "minmax_scale", "robust_scale")


def join_per_feature(long: DataFrame, fitted: DataFrame, keys: Sequence[str] = (), how: str = "left", n_rows: int = 0) -> DataFrame:
    """Attach fitted values; ``n_rows`` is the row bound the caller can prove."""
    small = F.broadcast(fitted) if 0 < n_rows <= MAX_BROADCAST_FEATURES else fitted
    return long.join(small, [*keys, "feature"], how)


# ---- imputation -------------------------------------------------------------

def fit_mean(long: DataFrame) -> DataFrame:
    return long.groupBy("feature").agg(F.avg("value").alias("fill"))


def fit_median(long: DataFrame) -> DataFrame:
    return exact_quantiles(long, ["feature"], "value", [0.5]).select("feature", F.col("quantiles")[0].alias("fill"))


def fit_mode(long: DataFrame) -> DataFrame:
    """Most frequent value, the smallest of equals."""
    counts = long.filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c"))
    best = counts.groupBy("feature").agg(F.max(F.struct("c", (-F.col("value")).alias("neg"))).alias("b"))
    return best.select("feature", (-F.col("b.neg") + F.lit(0.0)).alias("fill"))


def fit_zero(long: DataFrame) -> DataFrame:
    return long.groupBy("feature").agg(F.max(F.lit(0.0)).alias("fill"))


_FILLS = {"zeroes": fit_zero, "median": fit_median, "mean": fit_mean, "mode": fit_mode}


def fit_impute(
    long: DataFrame, by_modality: Mapping[str, Sequence[str]], modes: Mapping[str, str | None]
) -> DataFrame:
    """Fill values ``(feature, fill)`` with the mode chosen per modality name.

    One job per distinct mode, not per modality.  ``drop`` and ``None`` leave
    their features alone: dropping rows happens before the split.
    """
    for m in modes.values():
        if m not in IMPUTE_MODES:
            raise ValueError(f"unknown missing-data mode: {m}")
    parts = []
    for mode, fit in _FILLS.items():
        feats = [f for m, fs in by_modality.items() if modes.get(m) == mode for f in fs]
        if feats:
            parts.append(fit(long.filter(F.col("feature").isin(feats))))
    if not parts:
        return long.sparkSession.createDataFrame([], "feature string, fill double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rows_to_drop(by_modality: Mapping[str, Sequence[str]], modes: Mapping[str, str | None]) -> list[str]:
    """Columns that must be complete: those of every modality in ``drop`` mode."""
    return [f for m, fs in by_modality.items() if modes.get(m) == "drop" for f in fs]


def apply_impute(long: DataFrame, fills: DataFrame, n_features: int = 0) -> DataFrame:
    out = join_per_feature(long, fills, n_rows=n_features)
    return out.withColumn("value", F.coalesce("value", "fill")).drop("fill")


# ---- scaling ----------------------------------------------------------------

def _nonzero(c: Column) -> Column:
    return F.when(c == 0, 1.0).otherwise(c)


def fit_scale(long: DataFrame, kind: str, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, feature, center, scale)``; a zero scale is replaced by 1."""
    by = [*keys, "feature"]
    if kind == "standardize":
        s = long.groupBy(*by).agg(
            F.avg("value").alias("center"), F.stddev_pop("value").alias("sd"),
            F.min("value").alias("lo"), F.max("value").alias("hi"),
        )
        sd = F.when(F.col("lo") == F.col("hi"), 0.0).otherwise(F.col("sd"))
        return s.select(*by, "center", _nonzero(sd).alias("scale"))
    if kind == "minmax_scale":
        s = long.groupBy(*by).agg(F.min("value").alias("center"), F.max("value").alias("hi"))
        return s.select(*by, "center", _nonzero(F.col("hi") - F.col("center")).alias("scale"))
    if kind == "robust_scale":
        q = exact_quantiles(long, by, "value", [0.25, 0.5, 0.75], out="q")
        return q.select(*by, F.col("q")[1].alias("center"), _nonzero(F.col("q")[2] - F.col("q")[0]).alias("scale"))
    raise ValueError(f"unknown scaler: {kind}")


def fit_scales(long: DataFrame, by_modality: Mapping[str, Sequence[str]], kinds: Mapping[str, str]) -> DataFrame:
    """Scaler chosen per modality name; other modalities stay as they are."""
    parts = []
    for kind in dict.fromkeys(kinds.values()):
        feats = [f for m, fs in by_modality.items() if kinds.get(m) == kind for f in fs]
        if feats or kind not in SCALERS:
            parts.append(fit_scale(long.filter(F.col("feature").isin(feats)), kind))
    if not parts:
        return long.sparkSession.createDataFrame([], "feature string, center double, scale double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def apply_scale(long: DataFrame, scales: DataFrame, keys: Sequence[str] = (), n_features: int = 0) -> DataFrame:
    out = join_per_feature(long, scales, keys, n_rows=n_features)
    scaled = (F.col("value") - F.col("center")) / F.col("scale")
    return out.withColumn("value", F.when(F.col("scale").isNull(), F.col("value")).otherwise(scaled)).drop("center", "scale")


# ---- discretisation ---------------------------------------------------------

def fit_bins(
    long: DataFrame, n_bins: int = 10, strategy: str = "quantile", keys: Sequence[str] = (),
    weight: str | None = None, value: str = "value",
) -> DataFrame:
    """Inner bin edges ``(keys, feature, edges)``.

    ``quantile``: equally filled bins; edges closer than 1e-8 to the one before
    are dropped, as is any edge at the minimum.  ``uniform``: equally wide bins.
    """
    by = [*keys, "feature"]
    if strategy == "uniform":
        s = long.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
        width = (F.col("hi") - F.col("lo")) / n_bins
        edges = F.array(*[F.col("lo") + width * i for i in range(1, n_bins)])
        none = F.array().cast("array<double>")
        return s.select(*by, F.when(F.col("lo") == F.col("hi"), none).otherwise(edges).alias("edges"))
    if strategy != "quantile":
        raise ValueError(f"unknown binning strategy: {strategy}")
    probs = [i / n_bins for i in range(n_bins + 1)]
    q = exact_quantiles(long, by, value, probs, weight, "q")
    inner = F.filter(
        F.transform(F.sequence(F.lit(1), F.lit(n_bins - 1)), lambda i: F.struct(F.get("q", i).alias("e"), F.get("q", i - 1).alias("b"))),
        lambda s: s["e"] - s["b"] > 1e-8,
    )
    # the last bin is closed, so an edge at the maximum opens no bin of its own
    return q.select(
        *by,
        F.transform(F.filter(inner, lambda s: F.element_at("q", -1) - s["e"] > 1e-8), lambda s: s["e"]).alias("edges"),
    )


def bin_of(edges: Column, value: Column) -> Column:
    return F.when(value.isNotNull(), F.coalesce(count_at_most(edges, value), F.lit(0)))


def apply_bins(long: DataFrame, bins: DataFrame, keys: Sequence[str] = (), n_features: int = 0, value: str = "value") -> DataFrame:
    """Replace the value by its 0-based ``bin``: the number of edges <= value."""
    out = join_per_feature(long, bins, keys, "inner", n_features)
    return out.withColumn("bin", bin_of(F.col("edges"), F.col(value))).drop("edges", value)


def fit_levels(text: DataFrame, level: str = "level") -> DataFrame:
    """0-based codes of the sorted distinct levels, ``(feature, level, code)``.

    Works for numbers with a level per row as well: the order is found range
    by range, not in one sort per feature.
    """
    levels = text.filter(F.col(level).isNotNull()).groupBy("feature", level).agg(F.max(F.lit(1)).cast("bigint").alias("_one"))
    run = running_totals(levels, ["feature"], level, ["_one"])
    return run.select("feature", level, (F.col("_one_upto") - 1).cast("int").alias("code"))


def apply_levels(text: DataFrame, levels: DataFrame, level: str = "level") -> DataFrame:
    return text.join(levels, ["feature", level], "left").drop(level)


def discretize_target(
    df: DataFrame, time: str, mode: str = "discrete", n_bins: int = 10, fit_on: DataFrame | None = None, out: str = "y"
) -> DataFrame:
    """Screening target: binned time, raw time as a category, or time > median."""
    train = df if fit_on is None else fit_on
    if mode == "continuous":
        return df.withColumn(out, F.col(time))
    if mode == "median_binarized":
        med = exact_quantiles(train, [], time, [0.5]).select(F.col("quantiles")[0]).scalar()
        return df.withColumn(out, (F.col(time) > med).cast("int"))
    if mode == "discrete":
        edges = fit_bins(train.select(F.lit("t").alias("feature"), F.col(time).alias("value")), n_bins)
        return df.withColumn("_e", edges.select("edges").scalar()).withColumn(out, bin_of(F.col("_e"), F.col(time))).drop("_e")
    raise ValueError(f"unknown target mode: {mode}")
