"""Weighted ensembles and late fusion over the long prediction table.

Columns: run, split, row_id, model, modality, type, os, os_time, risk.  Weights
and extremes are one row per run, model and modality and are joined back; no
window covers prediction rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardlake.functions.ordered import join_null_safe
from hazardlake.operators.concordance import concordance_index
from hazardlake.session import keep, materialize

CELL = ["run", "split", "model", "modality"]
MAX_BROADCAST_CELLS = 100_000


def join_per_cell(pred: DataFrame, cells: DataFrame, on: Sequence[str]) -> DataFrame:
    """Attach a table of one row per cell; sent to every task up to ``MAX_BROADCAST_CELLS`` rows, so predictions stay in place."""
    cells = materialize(cells)
    small = cells.limit(MAX_BROADCAST_CELLS + 1).count() <= MAX_BROADCAST_CELLS
    return join_null_safe(pred, F.broadcast(cells) if small else cells, on)


def _used(pred: DataFrame, weight_split: str, score_split: str) -> DataFrame:
    """Predictions of the two splits, computed once for all their uses."""
    used = pred.filter(F.col("split").isin(weight_split, score_split))
    return keep(used.select(*CELL, "row_id", "os", "os_time", "risk"))


def cindex_grouped(pred: DataFrame, keys: Sequence[str] = CELL, risk: str = "risk") -> DataFrame:
    return concordance_index(pred, "os", "os_time", risk, keys)


def normalize_predictions(pred: DataFrame, keys: Sequence[str] = CELL, risk: str = "risk", out: str = "p") -> DataFrame:
    """Min-max scaled risk per cell; 0.5 where all risks of the cell are equal."""
    ends = pred.groupBy(*keys).agg(F.min(risk).alias("_lo"), F.max(risk).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    scaled = F.when(span == 0, 0.5).otherwise((F.col(risk) - F.col("_lo")) / span)
    return join_per_cell(pred, ends, keys).withColumn(out, scaled).drop("_lo", "_hi")


def ensemble_weights(cidx: DataFrame, within: Sequence[str], threshold: float = 0.5, out: str = "w") -> DataFrame:
    """max(C - threshold, 0) over their sum inside ``within``; all zero stays zero.

    Its window covers one row per model or modality.
    """
    raw = F.greatest(F.coalesce("cindex", F.lit(0.0)) - threshold, F.lit(0.0))
    total = F.sum(raw).over(Window.partitionBy(*within))
    return cidx.withColumn(out, F.when(total > 0, raw / total).otherwise(0.0))


def ensemble_weights_abs(cidx: DataFrame, within: Sequence[str], out: str = "w") -> DataFrame:
    """|C - 0.5| over their sum; ``flip`` marks models below 0.5."""
    raw = F.abs(F.coalesce("cindex", F.lit(0.5)) - 0.5)
    total = F.sum(raw).over(Window.partitionBy(*within))
    return cidx.withColumn(out, F.when(total > 0, raw / total).otherwise(0.0)).withColumn(
        "flip", F.coalesce(F.col("cindex") < 0.5, F.lit(False))
    )


def weighted_risk(pred: DataFrame, weights: DataFrame, on: Sequence[str], over: Sequence[str], p: str = "p") -> DataFrame:
    """Sum of w * p per row; flipped models enter as 1 - p.

    Rounded to 12 decimals: equal rows stay tied whatever the order of adding.
    """
    flip = F.col("flip") if "flip" in weights.columns else F.lit(False)
    j = join_per_cell(pred, weights.select(*on, "w", *(["flip"] if "flip" in weights.columns else [])), on)
    val = F.col("w") * F.when(flip, 1.0 - F.col(p)).otherwise(F.col(p))
    return j.groupBy(*over, "row_id").agg(F.max("os").alias("os"), F.max("os_time").alias("os_time"), F.round(F.sum(val), 12).alias("risk"))


def weighted_ensemble(pred: DataFrame, weight_split: str = "train", score_split: str = "test") -> DataFrame:
    """C-index per (run, modality) of two ensembles over models.

    ``all``: |C - 0.5| weights with flipping; ``filtered``: models above 0.5.
    Weights come from the C-index on ``weight_split``.
    """
    pred = _used(pred, weight_split, score_split)
    cidx = materialize(cindex_grouped(pred.filter(F.col("split") == weight_split), ["run", "model", "modality"]))
    scored = normalize_predictions(pred.filter(F.col("split") == score_split))
    within, on = ["run", "modality"], ["run", "model", "modality"]
    both = [("all", ensemble_weights_abs(cidx, within)), ("filtered", ensemble_weights(cidx, within, 0.5))]
    parts = [weighted_risk(scored, w, on, within).withColumn("ensemble", F.lit(n)) for n, w in both]
    c = concordance_index(parts[0].unionByName(parts[1]), "os", "os_time", "risk", [*within, "ensemble"])
    return c.select("run", "modality", "ensemble", "cindex")


def late_fusion(
    pred: DataFrame,
    types: Sequence[str] = ("ALL",),
    threshold: float = 0.53,
    weight_split: str = "val",
    score_split: str = "test",
    fused_ensemble: str = "mean",
) -> DataFrame:
    """C-index per (run, model, modality), with modality FUSED and model ENS added.

    FUSED sums modalities per model, ENS sums models per modality, both with
    weights from the validation C-index.  The ensemble of FUSED is the mean over
    models, or with ``fused_ensemble="last"`` the last model in name order.
    """
    from hazardlake.operators.cohort import filter_types

    if fused_ensemble not in ("mean", "last"):
        raise ValueError(f"unknown ensemble of fused predictions: {fused_ensemble}")
    pred = _used(filter_types(pred, types), weight_split, score_split)
    cidx = materialize(cindex_grouped(pred.filter(F.col("split") == weight_split), ["run", "model", "modality"]))
    scored = normalize_predictions(pred.filter(F.col("split") == score_split))
    on = ["run", "model", "modality"]
    base = scored.select("run", "model", "modality", "row_id", "os", "os_time", F.col("p").alias("risk"))
    fused = weighted_risk(scored, ensemble_weights(cidx, ["run", "model"], threshold), on, ["run", "model"])
    fused = materialize(fused.withColumn("modality", F.lit("FUSED")).select(*base.columns))
    ens = weighted_risk(scored, ensemble_weights(cidx, ["run", "modality"], threshold), on, ["run", "modality"])
    ens = ens.withColumn("model", F.lit("ENS")).select(*base.columns)
    pick = F.round(F.avg("risk"), 12) if fused_ensemble == "mean" else F.max_by("risk", "model")
    both = fused.groupBy("run", "row_id").agg(F.max("os").alias("os"), F.max("os_time").alias("os_time"), pick.alias("risk"))
    both = both.withColumn("model", F.lit("ENS")).withColumn("modality", F.lit("FUSED")).select(*base.columns)
    every = base.unionByName(fused).unionByName(ens).unionByName(both)
    return concordance_index(every, "os", "os_time", "risk", on).select(*on, "cindex")


def mean_ci_over_runs(cidx: DataFrame, by: Sequence[str] = ("modality", "model")) -> DataFrame:
    """Mean over runs and half width 1.96 * sd / sqrt(runs) of the 95% interval."""
    return cidx.groupBy(*by).agg(
        F.avg("cindex").alias("mean"), (F.lit(1.96) * F.stddev_pop("cindex") / F.sqrt(F.count("cindex"))).alias("ci95")
    )


def fusion_tables(summary: DataFrame, models: Sequence[str], value: str = "mean") -> DataFrame:
    """Modalities down, models across."""
    return summary.groupBy("modality").pivot("model", list(models)).agg(F.first(value))
