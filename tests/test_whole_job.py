"""Registered queries do the whole job: every split, and as many repetitions as their operators take by default."""

import inspect

import pytest
from pyspark.sql import functions as F

from checks import queries, screening
from checks import flow, models, outcomes  # noqa: F401
from hazardlake import fixtures as X
from hazardlake.operators import forest, importance, information, treeboost


class Seen(Exception):
    """Carries the arguments of a call out of a query."""


def default(fn, name):
    return inspect.signature(fn).parameters[name].default


def arguments(monkeypatch, module, name):
    """From now on a call of the function raises its arguments, defaults filled in."""
    fn = getattr(module, name)

    def stop(*args, **kw):
        bound = inspect.signature(fn).bind(*args, **kw)
        bound.apply_defaults()
        raise Seen(bound.arguments)

    monkeypatch.setattr(module, name, stop)


def called(query, *args):
    with pytest.raises(Seen) as seen:
        queries.QUERIES[query](*args)
    return seen.value.args[0]


def test_performance_covers_every_split(spark, monkeypatch):
    rows = spark.range(240).select(
        F.lit(1).alias("run"), F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), (F.col("id") % 3 + 1).cast("int")).alias("split"), F.col("id").alias("row_id"),
        F.element_at(F.array(*map(F.lit, ("GOOD", "WEAK"))), (F.col("id") % 2 + 1).cast("int")).alias("model"), F.lit("EXPRESSION").alias("modality"), F.lit("T").alias("type"),
        F.lit(1).alias("os"), (1.0 + F.col("id")).alias("os_time"), F.when(F.col("id") % 3 == 0, -F.col("id")).otherwise(F.col("id")).cast("double").alias("risk"),
    )
    monkeypatch.setattr(X, "predictions", lambda *_: rows)
    got = {r["split"]: (r["GOOD"], r["WEAK"], r["ANTI"]) for r in queries.QUERIES["write_performance"](spark, None).collect()}
    assert got == {"train": (1.0, 1.0, None), "val": (0.0, 0.0, None), "test": (0.0, 0.0, None)}


def test_importance_takes_every_shuffle(spark, monkeypatch):
    rows = spark.range(30).select(F.col("id").alias("row_id"), F.lit(1).alias("os"), (1.0 + F.col("id")).alias("os_time"), (1.0 * F.col("id")).alias("totalprice_exp"), (2.0 * F.col("id")).alias("acctbal_clin"))
    monkeypatch.setattr(X, "surv", lambda *_: rows)
    arguments(monkeypatch, importance, "permuted_columns")
    n = default(importance.permutation_importance, "n_iter")
    assert called("permutation_importance", spark, None)["n_iter"] == n == 15
    assert f"range(0,{n})" in queries.SQL["permutation_importance"]


def test_permutation_test_takes_every_permutation(spark, monkeypatch):
    bins = spark.range(30).select(F.col("id").alias("row_id"), F.lit("qty_exp").alias("feature"), (F.col("id") % 3).cast("int").alias("bin"))
    y = spark.range(30).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("y"))
    monkeypatch.setattr(screening, "binned_train", lambda *_: (bins, y, None))
    n = default(information.permuted_pairs, "n_perm")
    arguments(monkeypatch, information, "permuted_pairs")
    assert called("permutation_test_mi", spark, None)["n_perm"] == n == 200
    assert f"range(0,{n})" in queries.SQL["permutation_test_mi"]


def survival_rows(spark):
    """Rows that the models take, with a split of their own."""
    cols = dict(zip(["acctbal_clin", "totalprice_exp", "qty_exp", "disc_mut", "nlines_exp", "nret_mut"], (7, 11, 13, 17, 5, 3)))
    return spark.range(120).select(
        F.col("id").alias("row_id"), F.lit("train").alias("split"), F.lit("T").alias("type"), (F.col("id") % 2).cast("int").alias("os"), (1.0 + F.col("id") % 29).alias("os_time"),
        *[(1.0 * (F.col("id") * k % 31)).alias(c) for c, k in cols.items()],
    )


def test_boosting_takes_every_round(spark, monkeypatch):
    monkeypatch.setattr(models, "train_part", lambda *_: survival_rows(spark))
    arguments(monkeypatch, treeboost, "fit_families")
    seen = called("gb_cox_trees", spark, None)
    fit = treeboost.fit_tree_boost
    assert (seen["rounds"], seen["n_bins"], seen["families"][0].depth) == tuple(default(fit, k) for k in ("n_estimators", "n_bins", "max_depth")) == (100, 64, 3)
    assert "k < 100" in queries.SQL["gb_cox_trees"]


def test_forest_grows_every_tree_to_its_leaves(spark, monkeypatch):
    monkeypatch.setattr(models, "train_part", lambda *_: survival_rows(spark))
    arguments(monkeypatch, forest, "fit_forests")
    seen = called("random_survival_forest", spark, None)
    assert (seen["n_estimators"], seen["max_depth"]) == tuple(default(forest.fit_forest, k) for k in ("n_estimators", "max_depth")) == (100, None)
    assert "range(0, 100)" in queries.SQL["random_survival_forest"] and "depth <" not in queries.SQL["random_survival_forest"]
