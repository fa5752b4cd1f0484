"""Training, grid search and evaluation of the five survival models."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlake.operators import boosting, cohort, cox, forest, importance, treeboost
from hazardlake.operators.concordance import concordance_index
from hazardlake.session import materialize

MODELS = ("CPH-L2", "CPH-EN", "CPH-GB", "CLS-GB", "RSF")
LINEAR = ("CPH-L2", "CPH-EN", "CLS-GB")


def default_grid(model: str, n_features: int) -> dict[str, Sequence]:
    grids: dict[str, dict[str, Sequence]] = {
        "CPH-L2": {"alpha": cox.RIDGE_ALPHAS},
        "CPH-EN": {"l1_ratio": cox.NET_L1_RATIOS, "alpha_min_ratio": cox.NET_MIN_RATIOS},
        "CPH-GB": {
            "n_estimators": boosting.N_ESTIMATORS, "learning_rate": boosting.LEARNING_RATES,
            "max_depth": tuple(dict.fromkeys((1, max(1, n_features // 2)))),
        },
        "CLS-GB": {"n_estimators": boosting.N_ESTIMATORS, "learning_rate": boosting.LEARNING_RATES},
        "RSF": {
            "n_estimators": forest.N_ESTIMATORS, "min_samples_split": forest.MIN_SPLIT, "min_samples_leaf": forest.MIN_LEAF,
            "max_features": ("sqrt",),
        },
    }
    if model not in grids:
        raise ValueError(f"unknown survival model: {model}")
    return grids[model]


def expand_grid(grid: Mapping[str, Sequence]) -> list[dict[str, Any]]:
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def _fit_linear(model: str, rows, features, configs, held_out, options) -> list[cox.CoxModel]:
    if model == "CPH-L2":
        return cox.fit_ridge(rows, features, [c["alpha"] for c in configs], held_out, **options)
    if model == "CPH-EN":
        return cox.fit_elastic_net(rows, features, [(c["l1_ratio"], c["alpha_min_ratio"]) for c in configs], held_out, **options)
    return boosting.fit_componentwise(rows, features, [(c["n_estimators"], c["learning_rate"]) for c in configs], held_out, **options)


def fit_model(model: str, rows: DataFrame, features: Sequence[str], config: Mapping[str, Any], options: Mapping | None = None):
    """One model on ``(row_id, os, os_time, x)`` under one configuration."""
    options = dict(options or {})
    if model in LINEAR:
        return _fit_linear(model, rows, features, [config], None, options)[0]
    if model == "CPH-GB":
        return treeboost.fit_tree_boost(rows, features, config["n_estimators"], config["learning_rate"], config["max_depth"], **options)
    if model == "RSF":
        return forest.fit_forest(rows, features, **config, **options)
    raise ValueError(f"unknown survival model: {model}")


def score_rows(fitted, rows: DataFrame, out: str = "risk") -> DataFrame:
    """Risk per row: an expression for linear models, tree walks otherwise."""
    if isinstance(fitted, cox.CoxModel):
        return rows.withColumn(out, fitted.eta())
    return fitted.score(rows, out)


def _held_out_trees(model: str, rows, features, configs, folds, options) -> tuple[DataFrame, list[Column]]:
    """Rows with the scores of all tree fits, and the risk of every configuration.

    Configurations that differ in the number of trees only are prefixes of one fit; all fits run together.
    """
    keys = ("learning_rate", "max_depth") if model == "CPH-GB" else ("min_samples_split", "min_samples_leaf")
    if len({c.get("max_features") for c in configs}) > 1:
        raise ValueError("one max_features per search")
    kinds = list(dict.fromkeys(tuple(c[k] for k in keys) for c in configs))
    prefixes = sorted({c["n_estimators"] for c in configs})
    fits = [(kind, f) for kind in kinds for f in range(folds)]
    if model == "CPH-GB":
        fitted = treeboost.fit_families(rows, features, [treeboost.Family(*kind, f) for kind, f in fits], prefixes[-1], **options)
    else:
        fitted = forest.fit_forests(
            rows, features, [forest.Fit(*kind, f) for kind, f in fits], prefixes[-1], configs[0].get("max_features", "sqrt"), **options
        )
    scored = fitted.prefix_scores(rows, prefixes, {i: f for i, (_, f) in enumerate(fits)}, "_s")
    risks = []
    for c in configs:
        kind, k = kinds.index(tuple(c[k] for k in keys)), prefixes.index(c["n_estimators"])
        risks.append(F.get("_s", ((kind * folds + F.col("fold")) * len(prefixes) + k).cast("int")))
    return scored, risks


def grid_search(
    model: str, rows: DataFrame, features: Sequence[str], grid: Mapping[str, Sequence] | None = None, folds: int = 5,
    options: Mapping | None = None,
) -> tuple[dict[str, Any], DataFrame]:
    """Best configuration and ``(config, cindex)`` averaged over held-out folds.

    ``rows`` carries ``fold``. All (configuration, fold) pairs are fitted in the same passes, whatever the
    model, and all held-out scores go through a single grouped concordance
    job; the lowest configuration number wins ties.
    """
    configs = expand_grid(grid or default_grid(model, len(features)))
    if model in LINEAR:
        pairs = [(c, f) for c in range(len(configs)) for f in range(folds)]
        fitted = _fit_linear(model, rows, features, [configs[c] for c, _ in pairs], [f for _, f in pairs], dict(options or {}))
        of = dict(zip(pairs, fitted))
        # only the model that left the row's fold out is evaluated
        risks = [F.coalesce(*[F.when(F.col("fold") == f, of[c, f].eta()) for f in range(folds)]) for c in range(len(configs))]
        scored = rows
    else:
        scored, risks = _held_out_trees(model, rows, features, configs, folds, dict(options or {}))
    exploded = F.explode(F.array(*[F.struct(F.lit(c).alias("config"), r.alias("risk")) for c, r in enumerate(risks)]))
    scored = scored.select("os", "os_time", "fold", exploded.alias("s")).select("os", "os_time", "fold", "s.config", "s.risk")
    c = concordance_index(scored, "os", "os_time", "risk", ["config", "fold"])
    table = materialize(c.groupBy("config").agg(F.avg("cindex").alias("cindex")))
    best = table.orderBy(F.round("cindex", 10).desc_nulls_last(), "config").first()["config"]
    return configs[best], table


@dataclass
class Trained:
    model: str
    config: dict[str, Any]
    fitted: Any
    predictions: DataFrame
    cindex: dict[str, float | None]
    importances: DataFrame | None


def _model_rows(data: DataFrame, features: Sequence[str]) -> DataFrame:
    x = F.array(*[F.col(f).cast("double") for f in features]).alias("x")
    return materialize(data.select("row_id", "split", "type", "os", "os_time", x))


def train_and_evaluate(
    data: DataFrame, features: Sequence[str], model: str, grid: Mapping[str, Sequence] | None = None, folds: int = 5,
    importances: bool = False, n_iter: int = 15, seed=0, options: Mapping | None = None, rows: DataFrame | None = None,
) -> Trained:
    """Grid search and refit on train, then C-index and risk on every split.

    ``data`` has row_id, split, os, os_time, type and the feature columns; ``rows`` are
    the same with the vector ``x`` for features, where the caller has made them.
    """
    if model not in MODELS:
        raise ValueError(f"unknown survival model: {model}")
    rows = _model_rows(data, features) if rows is None else rows
    train = cohort.hash_folds(rows.filter("split = 'train'"), "row_id", folds, seed)
    grid = grid or default_grid(model, len(features))
    configs = expand_grid(grid)
    best = configs[0] if len(configs) == 1 else grid_search(model, train, features, grid, folds, options)[0]
    fitted = fit_model(model, train, features, best, options)
    pred = score_rows(fitted, rows).select("split", "row_id", F.lit(model).alias("model"), "type", "os", "os_time", "risk")
    pred = materialize(pred)
    cidx = {r["split"]: r["cindex"] for r in concordance_index(pred, "os", "os_time", "risk", ["split"]).collect()}
    table = None
    if importances:
        test = data.filter("split = 'test'").join(pred.select("row_id", "risk"), "row_id")
        if isinstance(fitted, cox.CoxModel):
            imp = importance.permutation_importance(test, features, dict(zip(features, fitted.coef)), n_iter=n_iter, seed=seed)
        else:
            back = lambda df: score_rows(fitted, df.withColumn("x", F.array(*[F.col(f).cast("double") for f in features])))
            imp = importance.permutation_importance(test, features, score=back, n_iter=n_iter, seed=seed)
        table = importance.importance_table(imp, model, cidx.get("test"), cidx.get("val"), cidx.get("train"))
    return Trained(model, best, fitted, pred, cidx, table)


def model_pool(data: DataFrame, features: Sequence[str], models: Sequence[str], grids: Mapping[str, Mapping] | None = None, options: Mapping[str, Mapping] | None = None, **kw) -> list[Trained]:
    """Every model of one run, all on the same rows."""
    rows = _model_rows(data, features) if models else None
    return [train_and_evaluate(data, features, m, (grids or {}).get(m), options=(options or {}).get(m), rows=rows, **kw) for m in models]
