"""Registered queries: stored results and whole experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import modelsql as M
from checks import sqltext as S
from checks.outcomes import cidx_cte
from checks.queries import q, r6, train_part
from hazardlake import fixtures as X
from hazardlake.operators import cohort, concordance, ensemble, schema
from hazardlake.plans.experiment import Options, run_experiment
from hazardlake.session import materialize, staging_path
from hazardlake.sources import sinks, tables


@q("write_splits", S.with_(S.SURV, S.subject_split(7, 0.8)) + "SELECT CAST(1 AS INTEGER) AS run, split, count(*) AS n, round(sum(qty_exp),6)+0.0 AS qty FROM surv JOIN split_of USING (subject_id) GROUP BY split")
def write_splits(spark, sf):
    path = staging_path(spark, "splits")
    sinks.write_splits(train_part(spark, sf).select("row_id", "os", "os_time", "qty_exp", "split").withColumn("run", F.lit(1)), path)
    return spark.read.parquet(path).groupBy("run", "split").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("qty_exp"), "qty"))


@q("write_predictions", S.with_(S.SURV, S.PREDICTIONS) + "SELECT run, split, model, count(*) AS n, round(sum(risk),4)+0.0 AS total FROM predictions GROUP BY ALL")
def write_predictions(spark, sf):
    path = staging_path(spark, "predictions")
    sinks.write_predictions(X.predictions(spark, sf), path)
    p = spark.read.parquet(path)
    return p.groupBy("run", "split", "model").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("risk"), 4) + F.lit(0.0)).alias("total"))


@q("write_selected_features", S.with_(S.SURV) + """SELECT CAST(1 AS INTEGER) AS run, feature, row_number() OVER (ORDER BY n DESC, feature) AS rank FROM
 (SELECT feature, count(value) AS n FROM (""" + S.with_(S.long_cte("surv", S.FULL, name="w0")) + "SELECT * FROM w0) GROUP BY feature)")
def write_selected_features(spark, sf):
    from pyspark.sql import Window

    long = schema.melt(X.surv(spark, sf), S.FULL, ["row_id"])
    n = long.groupBy("feature").agg(F.count("value").alias("n"))
    ranked = n.select(F.lit(1).alias("run"), "feature", F.row_number().over(Window.orderBy(F.col("n").desc(), "feature")).alias("rank"))
    path = staging_path(spark, "selected")
    sinks.write_selected_features(ranked, path)
    return spark.read.parquet(path)


_M = ["ANTI", "CONST", "GOOD", "WEAK"]


@q("write_performance", S.with_(S.SURV, S.PREDICTIONS, cidx_cte("c", "predictions", ["run", "split", "model", "modality"])) + "SELECT run, split, modality, " + ", ".join(f"round(max(cindex) FILTER (model='{m}'),6)+0.0 AS {m}" for m in _M) + " FROM c GROUP BY run, split, modality")
def write_performance(spark, sf):
    c = ensemble.cindex_grouped(X.predictions(spark, sf))
    path = staging_path(spark, "performance")
    sinks.write_performance(c, _M, path, ["run", "split", "modality"])
    return spark.read.parquet(path).select("run", "split", "modality", *[r6(F.col(m), m) for m in _M])


@q("checkpoint_run", S.with_(S.SURV) + f"""SELECT CAST(run AS INTEGER) AS run, split, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS id_sum FROM
 (SELECT run, row_id, CASE WHEN rk <= m - ceil(CAST({1 - 0.8!r} AS DOUBLE)*m) THEN 'train' ELSE 'test' END AS split FROM
   (SELECT run, row_id, row_number() OVER (PARTITION BY run ORDER BY md5(run||':'||row_id), row_id) AS rk, count(*) OVER (PARTITION BY run) AS m FROM surv, (SELECT unnest([1,2,3]) AS run))) GROUP BY ALL""")
def checkpoint_run(spark, sf):
    ids = materialize(X.surv(spark, sf).select("row_id"))
    path = staging_path(spark, "runs")

    def compute(todo):
        runs = [r["run"] for r in todo.collect()]
        each = cohort.repeat_runs(ids, runs).withColumn("run", F.col("seed"))
        return cohort.split_rows(each, "row_id", 0.8, F.col("run"), ["run"]).select("run", "row_id", "split")

    table = lambda runs: spark.createDataFrame([(r,) for r in runs], "run int")
    sinks.checkpoint_runs(spark, path, table([1, 2]), compute)
    done = sinks.checkpoint_runs(spark, path, table([1, 2, 3]), compute)  # adds run 3 only
    return done.groupBy("run", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("id_sum"))


@q("run_seeds", S.with_(S.SURV) + f"""SELECT type, seed % 2 AS odd, count(*) AS n FROM surv JOIN (SELECT CAST(seed AS BIGINT) AS seed, row_number() OVER (ORDER BY md5('8:'||seed), seed) AS run FROM (SELECT unnest(range(1,1000)) AS seed)) s
   ON s.run = 1 + row_id % 5 GROUP BY ALL""")
def run_seeds(spark, sf):
    seeds = sinks.run_seeds(spark, staging_path(spark, "seeds"), 5, 8)
    s = X.surv(spark, sf).withColumn("run", (1 + F.pmod("row_id", F.lit(5))).cast("int"))
    return s.join(F.broadcast(seeds), "run").groupBy("type", (F.col("seed") % 2).cast("bigint").alias("odd")).agg(F.count(F.lit(1)).alias("n"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def small(fusion, **kw):
    base = dict(
        suffixes=X.SUFFIXES, subsets=[["EXPRESSION", "MUTATION"]], types=[["ALL"]], seeds=[7],
        models=["CPH-L2", "CLS-GB"], missing={"EXPRESSION": "median", "MUTATION": "mean"}, scalers={"EXPRESSION": "standardize", "MUTATION": "minmax_scale"},
        variance_threshold=1e-6, k=2, n_bootstraps=2, stability_threshold=1, method="MIM", fusion=fusion,
        grids={"CPH-L2": {"alpha": [1.0]}, "CLS-GB": {"n_estimators": [3], "learning_rate": [0.8]}},
    )
    return Options(**{**base, **kw})


@q("experiment_flow")
def experiment_flow(spark, sf):
    out = run_experiment(X.surv(spark, sf), small("early"))
    return out["performance"].select("types", "subset", "run", "split", "model", r6(F.col("cindex"), "cindex"))


@q("intermediate_fusion")
def intermediate_fusion(spark, sf):
    out = run_experiment(X.surv(spark, sf), small("intermediate", models=["CPH-L2"]))
    return out["selected"]


@q("late_fusion_flow")
def late_fusion_flow(spark, sf):
    out = run_experiment(X.surv(spark, sf), small("late", models=["CPH-L2"], n_bootstraps=0))
    return out["fusion"].select("run", "model", "modality", r6(F.col("cindex"), "cindex"))


@q("per_group_models", M.per_type(["disc_mut", "tax_mut", "nret_mut"], cidx_cte("c", "scored", ["type", "split"])))
def per_group_models(spark, sf):
    out = run_experiment(X.surv(spark, sf), small("early", types=[[t] for t in SEGMENTS], subsets=[["MUTATION"]], models=["CPH-L2"], selection="none",
                                                    model_options={"CPH-L2": {"tol": 1e-14, "max_iter": 60}}))
    # averages that are equal but for their last bits are ties
    c = concordance.concordance_index(out["predictions"].withColumn("risk", F.round("risk", 6)), "os", "os_time", "risk", ["types", "split"])
    return c.select("types", "split", r6(F.col("cindex"), "cindex"))
