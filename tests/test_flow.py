import pytest
from pyspark.sql import functions as F

from checks import compare
from checks.flow import small
from hazardlake import fixtures as X
from hazardlake.operators import modelling
from hazardlake.plans import experiment
from hazardlake.plans.experiment import run_experiment
from hazardlake.session import materialize
from hazardlake.sources import sinks, tables

SF = "/root/testdata/sf0.001"


def test_late_fusion_experiment(spark):
    out = run_experiment(X.surv(spark, SF), small("late", models=["CPH-L2"], seeds=[7, 8], n_bootstraps=0))
    assert {r["modality"] for r in out["fusion"].select("modality").distinct().collect()} == {"EXPRESSION", "MUTATION", "FUSED"}
    assert out["predictions"].select("run").distinct().count() == 2
    assert {r["split"] for r in out["performance"].select("split").distinct().collect()} == {"train", "val", "test"}


def test_grouped_features_and_categories(spark):
    o = small("early", handle_correlated="group", categorical=["status_clin"], subsets=[["CLINICAL", "EXPRESSION"]], models=["CPH-L2"],
              missing={"EXPRESSION": "median", "CLINICAL": "mode"}, forced_column="pdl1_status", k=4)
    data = X.surv(spark, SF).drop("nation_clin")
    names = {r["feature"] for r in run_experiment(data, o)["selected"].collect()}
    assert any(n.startswith("group_") for n in names)


def test_unknown_choices(spark):
    with pytest.raises(ValueError):
        run_experiment(spark.range(1), small("other"))


def test_stored_runs_are_not_computed_again(spark, tmp_path):
    path, seen = str(tmp_path / "runs"), []

    def compute(todo):
        seen.extend(sorted(r["run"] for r in todo.collect()))
        return todo.withColumn("v", F.col("run") * 10)

    runs = lambda *r: spark.createDataFrame([(i,) for i in r], "run int")
    sinks.checkpoint_runs(spark, path, runs(1, 2), compute)
    got = sinks.checkpoint_runs(spark, path, runs(1, 2, 3), compute)
    assert seen == [1, 2, 3] and got.count() == 3
    other = sinks.checkpoint_runs(spark, str(tmp_path / "new"), runs(9), compute, archive=path)
    assert other.count() == 3 and seen == [1, 2, 3]


def test_runs_cut_off_while_writing_are_done_again(spark, tmp_path):
    path = str(tmp_path / "runs")
    runs = spark.createDataFrame([(1,)], "run int")

    def broken(todo):
        return todo.withColumn("v", F.raise_error(F.lit("executor lost")).cast("int"))

    with pytest.raises(Exception, match="executor lost"):
        sinks.checkpoint_runs(spark, path, runs, broken)
    # tables of an attempt without a manifest row
    runs.withColumn("v", F.lit(-1)).write.parquet(f"{path}/data/halfway/result")
    got = sinks.checkpoint_runs(spark, path, runs, lambda todo: todo.withColumn("v", F.lit(7)))
    assert [tuple(r) for r in got.collect()] == [(1, 7)]


def test_experiment_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    options = small("early", models=["CPH-L2"], seeds=[7, 8], n_bootstraps=0, selection="none", subsets=[["MUTATION"]])
    data, store, calls = X.surv(spark, SF), str(tmp_path / "store"), []
    prepare, pool = experiment.prepare, modelling.model_pool

    def counted(df, o, subset, seed):
        calls.append(("prepare", seed))
        return prepare(df, o, subset, seed)

    def stopping(part, feats, *args, **kw):
        calls.append(("models", kw["seed"]))
        if stop and kw["seed"] == 8:
            raise KeyboardInterrupt
        return pool(part, feats, *args, **kw)

    monkeypatch.setattr(experiment, "prepare", counted)
    monkeypatch.setattr(modelling, "model_pool", stopping)
    stop = True
    with pytest.raises(KeyboardInterrupt):
        experiment.run_experiment(data, options, store)
    assert calls == [("prepare", 7), ("models", 7), ("prepare", 8), ("models", 8)]
    stop, _ = False, calls.clear()
    resumed = experiment.run_experiment(data, options, store)
    assert calls == [("models", 8)]
    plain = experiment.run_experiment(data, options)
    for name in ("performance", "selected", "predictions"):
        a, b = (sorted(map(str, t[name].collect())) for t in (resumed, plain))
        assert a == b, name
    calls.clear()
    other = small("early", models=["CPH-L2"], seeds=[7], n_bootstraps=0, selection="none", subsets=[["MUTATION"]], fraction=0.7)
    experiment.run_experiment(data, other, store)
    assert calls == [("prepare", 7), ("models", 7)]  # other options, other steps


def test_seeds_are_kept(spark, tmp_path):
    a = [r["seed"] for r in sinks.run_seeds(spark, str(tmp_path / "s"), 4, 1).orderBy("run").collect()]
    b = [r["seed"] for r in sinks.run_seeds(spark, str(tmp_path / "s"), 4, 2).orderBy("run").collect()]
    assert a == b and len(set(a)) == 4
    with pytest.raises(ValueError):
        tables.draw_seeds(spark, 0)


def test_materialized_tables_survive_cleared_cache(spark):
    df = materialize(spark.range(10))
    spark.catalog.clearCache()
    assert df.count() == 10


NAMES = ["scan_csv", "split_validation", "repeat_runs", "quantile_bins", "mim", "jmi", "cindex_grouped", "kaplan_meier", "late_fusion", "knn_entropy", "stability_select"]


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    import __spark_entry__ as entry

    r = compare.compare(spark, compare.connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert r["ok"], r


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["feature", "mi", "rank"]


def test_source_is_derived_once_for_all_groups(spark, tmp_path):
    folder = str(tmp_path)

    def noted(batches):
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        yield from batches

    rows = [(i, i, "ab"[i % 2], i % 3 > 0, 1.0 + i % 11, float(i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id int, subject_id int, type string, os boolean, os_time double, f_exp double")
    df = df.selectExpr("row_id", "subject_id", "type", "CAST(os AS INT) AS os", "os_time", "f_exp").repartition(2)
    o = experiment.Options({"EXPRESSION": "_exp"}, [["EXPRESSION"]], types=[["a"], ["b"]], seeds=[1], selection="none", grids={"CPH-L2": {"alpha": [1.0]}})
    out = run_experiment(df.mapInArrow(noted, df.schema), o)
    assert {r["types"] for r in out["performance"].collect()} == {"a", "b"}
    assert len(list(tmp_path.iterdir())) <= 2
