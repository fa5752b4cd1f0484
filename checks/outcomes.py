"""Registered queries: survival statistics, concordance, ensembles and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sqltext as S
from checks.queries import TRAIN, q, r6, train_part
from hazardlake import fixtures as X
from hazardlake.operators import concordance, curves, ensemble, importance, survival
from hazardlake.session import materialize

SURV = S.with_(S.SURV)
PRED = S.with_(S.SURV, S.PREDICTIONS)


def theta(source: str, by: list[str], risk: str = "risk") -> str:
    """Concordance by the plain pair join."""
    on = "".join(f" AND a.{k}=b.{k}" for k in by)
    cols = ", ".join(f"a.{k}" for k in by)
    return f"""SELECT {cols + ',' if by else ''} CAST(sum(CASE WHEN a.{risk} > b.{risk} THEN 1 ELSE 0 END) AS BIGINT) AS concordant,
  CAST(sum(CASE WHEN a.{risk} = b.{risk} THEN 1 ELSE 0 END) AS BIGINT) AS tied, count(*) AS comparable
  FROM {source} a JOIN {source} b ON a.os=1 AND (a.os_time < b.os_time OR (a.os_time = b.os_time AND b.os=0)){on} {'GROUP BY ' + cols if by else ''}"""


def cidx_cte(name: str, source: str, by: list[str]) -> str:
    cols = ", ".join(by)
    return f"{name} AS (SELECT {cols + ',' if by else ''} concordant, tied, comparable, (concordant + 0.5*tied)/comparable AS cindex FROM ({theta(source, by)}))"


@q("comparable_pairs", S.with_(S.SURV, "b AS (SELECT type, os, os_time, totalprice_exp AS risk FROM surv)") + f"SELECT type, comparable FROM ({theta('b', ['type'])})")
def comparable_pairs(spark, sf):
    s = X.surv(spark, sf)
    return concordance.concordance_index(s, "os", "os_time", "totalprice_exp", ["type"]).select("type", "comparable")


@q("concordance_index", S.with_(S.SURV, "b AS (SELECT os, os_time, qty_exp AS risk FROM surv WHERE qty_exp IS NOT NULL)", cidx_cte("c", "b", []))
   + "SELECT concordant, tied, comparable, round(cindex,6)+0.0 AS cindex FROM c")
def concordance_index(spark, sf):
    c = concordance.concordance_index(X.surv(spark, sf), "os", "os_time", "qty_exp")
    return c.select("concordant", "tied", "comparable", r6(F.col("cindex"), "cindex"))


@q("cindex_grouped", S.with_(S.SURV, S.PREDICTIONS, cidx_cte("c", "predictions", ["run", "split", "model", "modality"])) + "SELECT run, split, model, modality, comparable, round(cindex,6)+0.0 AS cindex FROM c")
def cindex_grouped(spark, sf):
    c = ensemble.cindex_grouped(X.predictions(spark, sf))
    return c.select("run", "split", "model", "modality", "comparable", r6(F.col("cindex"), "cindex"))


_EV = """ev AS (SELECT study, os_time AS time, CAST(sum(os) AS BIGINT) AS events, CAST(count(*)-sum(os) AS BIGINT) AS censored,
   CAST(sum(count(*)) OVER (PARTITION BY study ORDER BY os_time DESC) AS BIGINT) AS at_risk FROM surv GROUP BY study, os_time)"""


@q("kaplan_meier", S.with_(S.SURV, _EV) + """SELECT study, time, events, censored, at_risk,
 round(product(1 - CAST(events AS DOUBLE)/at_risk) OVER (PARTITION BY study ORDER BY time),6)+0.0 AS survival FROM ev""")
def kaplan_meier(spark, sf):
    km = survival.kaplan_meier(X.surv(spark, sf), "os", "os_time", ["study"])
    return km.select("study", "time", "events", "censored", "at_risk", r6(F.col("survival"), "survival"))


@q("at_risk_counts", SURV + """SELECT study, time, count(*) FILTER (os_time >= time) AS at_risk, count(*) FILTER (os_time <= time AND os=1) AS events,
 count(*) FILTER (os_time <= time AND os=0) AS censored FROM surv, (SELECT unnest([CAST(0 AS DOUBLE),100,365,1000]) AS time) GROUP BY ALL""")
def at_risk_counts(spark, sf):
    return survival.at_risk_counts(X.surv(spark, sf), "os", "os_time", [0, 100, 365, 1000], ["study"])


_ETA = "(totalprice_exp/1e6 - acctbal_clin/2e4)"
_RS = f"""rs AS (SELECT type, os_time AS time, CAST(sum(os) AS BIGINT) AS d, sum(exp({_ETA})) AS e0, sum(exp({_ETA})*totalprice_exp) AS e1 FROM surv GROUP BY ALL),
 rr AS (SELECT type, time, d, sum(e0) OVER (PARTITION BY type ORDER BY time DESC) AS s0, sum(e1) OVER (PARTITION BY type ORDER BY time DESC) AS s1 FROM rs)"""


@q("risk_set_sums", S.with_(S.SURV, _RS) + "SELECT type, time, d, round(s0,6)+0.0 AS s0, round(s1/1e6,6)+0.0 AS s1 FROM rr")
def risk_set_sums(spark, sf):
    r = survival.risk_set_sums(X.surv(spark, sf), "os", "os_time", F.expr(_ETA), ["totalprice_exp"], ["type"])
    return r.select("type", "time", "d", r6(F.col("s0"), "s0"), r6(F.col("s1_totalprice_exp") / 1e6, "s1"))


@q("baseline_hazard", S.with_(S.SURV, _RS) + "SELECT type, time, round(sum(d/s0) OVER (PARTITION BY type ORDER BY time),6)+0.0 AS hazard FROM rr")
def baseline_hazard(spark, sf):
    hz = survival.baseline_hazard(X.surv(spark, sf), "os", "os_time", F.expr(_ETA), ["type"])
    return hz.select("type", "time", r6(F.col("hazard"), "hazard"))


@q("predict_survival", S.with_(S.SURV, _RS, "hz AS (SELECT type, time, sum(d/s0) OVER (PARTITION BY type ORDER BY time) AS hazard FROM rr)",
   "pts AS (SELECT type, t, max(hazard) FILTER (time <= t) AS h0 FROM hz, (SELECT unnest([CAST(90 AS DOUBLE),365]) AS t) GROUP BY ALL)") +
   f"SELECT row_id, t AS time, round(exp(-coalesce(h0,0)*exp({_ETA})),6)+0.0 AS survival FROM surv JOIN pts USING (type)")
def predict_survival(spark, sf):
    s = X.surv(spark, sf)
    hz = survival.baseline_hazard(s, "os", "os_time", F.expr(_ETA), ["type"])
    out = survival.predict_survival(s, hz, [90, 365], F.expr(_ETA), ["type"])
    return out.select("row_id", "time", r6(F.col("survival"), "survival"))


@q("box_stats", PRED + """SELECT run, model, round(min(risk),6)+0.0 AS low, round(quantile_cont(risk,0.25),6)+0.0 AS q1, round(quantile_cont(risk,0.5),6)+0.0 AS median,
 round(quantile_cont(risk,0.75),6)+0.0 AS q3, round(max(risk),6)+0.0 AS high FROM predictions GROUP BY ALL""")
def box_stats(spark, sf):
    b = survival.box_stats(X.predictions(spark, sf), "risk", ["run", "model"])
    return b.select("run", "model", *[r6(F.col(c), c) for c in ("low", "q1", "median", "q3", "high")])


# survival curves that differ between rows: S(t|x) = exp(-(t/1000)^k * e^eta), k by study
@q("concordance_td", S.with_(S.SURV, """cv AS (SELECT row_id, type, os, os_time, CASE study WHEN 'ASIA' THEN 1.5 ELSE 1.0 END AS k, totalprice_exp/1e6 AS eta FROM surv)""",
   """pr AS (SELECT exp(-pow(ceil(a.os_time/250)*0.25, a.k)*exp(a.eta)) AS si, exp(-pow(ceil(a.os_time/250)*0.25, b.k)*exp(b.eta)) AS sj
     FROM cv a JOIN cv b ON a.os=1 AND (a.os_time < b.os_time OR (a.os_time = b.os_time AND b.os=0)))""") +
   """SELECT count(*) FILTER (si < sj) AS concordant, count(*) FILTER (si = sj) AS tied, count(*) AS comparable FROM pr""")
def concordance_td(spark, sf):
    s = X.surv(spark, sf)
    curves = s.select("row_id", "os", "os_time", F.when(F.col("study") == "ASIA", 1.5).otherwise(1.0).alias("k"), (F.col("totalprice_exp") / 1e6).alias("eta"))
    grid = [250.0 * i for i in range(1, 10)]
    surv_at = F.array(*[F.exp(-F.pow(F.lit(g / 1000.0), F.col("k")) * F.exp("eta")) for g in grid])
    c = concordance.concordance_td(curves.withColumn("curve", surv_at), "os", "os_time", "curve", grid)
    return c.select("concordant", "tied", "comparable")


@q("concordance_td_curves", S.with_(S.SURV,
   "cv AS (SELECT row_id, type, os, os_time, 50.0*(1 + row_id % 5) AS step, 6 + row_id % 3 AS most, 0.5 + totalprice_exp/2e5 AS h FROM surv)",
   # the last point of the own grid at or before the time; 1 before the first one
   """pr AS (SELECT a.type, least(floor(a.os_time/a.step), a.most)*a.step AS ti, a.h AS hi, least(floor(a.os_time/b.step), b.most)*b.step AS tj, b.h AS hj
     FROM cv a JOIN cv b ON a.type = b.type AND a.os=1 AND (a.os_time < b.os_time OR (a.os_time = b.os_time AND b.os=0)))""",
   "va AS (SELECT type, CASE WHEN ti = 0 THEN 1 ELSE round(exp(-ti/1000*hi), 6) END AS si, CASE WHEN tj = 0 THEN 1 ELSE round(exp(-tj/1000*hj), 6) END AS sj FROM pr)")
   + "SELECT type, count(*) FILTER (si < sj) AS concordant, count(*) FILTER (si = sj) AS tied, count(*) AS comparable FROM va GROUP BY type")
def concordance_td_curves(spark, sf):
    s = X.surv(spark, sf)
    step, most = 50.0 * (1 + F.pmod("row_id", F.lit(5))), (6 + F.pmod("row_id", F.lit(3))).cast("int")
    grid = s.select("type", "row_id", (0.5 + F.col("totalprice_exp") / 2e5).alias("h"), F.explode(F.transform(F.sequence(F.lit(1), most), lambda k: k * step)).alias("time"))
    points = grid.select("type", "row_id", "time", F.round(F.exp(-F.col("time") / 1000 * F.col("h")), 6).alias("survival"))
    return curves.concordance_curves(s, points, ["type"]).select("type", "concordant", "tied", "comparable")


_SHUFFLES = 15


@q("permutation_importance", S.with_(S.SURV, "b0 AS (SELECT row_id, os, os_time, totalprice_exp AS a, acctbal_clin AS b, -totalprice_exp/1e6 + acctbal_clin/2e4 AS risk FROM surv)",
   cidx_cte("base", "b0", []), "lg AS (SELECT row_id, os, os_time, risk, unnest(['totalprice_exp','acctbal_clin']) AS feature, unnest([a, b]) AS own, unnest([-1/1e6, 1/2e4]) AS coef FROM b0)",
   f"it AS (SELECT lg.*, iter FROM lg, (SELECT unnest(range(0,{_SHUFFLES})) AS iter))",
   "t1 AS (SELECT *, row_number() OVER (PARTITION BY feature, iter ORDER BY md5('3:to:'||feature||':'||iter||':'||row_id), row_id) AS k FROM it)",
   "f1 AS (SELECT feature, iter, own AS permuted, row_number() OVER (PARTITION BY feature, iter ORDER BY md5('3:from:'||feature||':'||iter||':'||row_id), row_id) AS k FROM it)",
   "mv AS (SELECT t1.feature, t1.iter, os, os_time, risk + coef*(permuted-own) AS risk FROM t1 JOIN f1 ON t1.feature=f1.feature AND t1.iter=f1.iter AND t1.k=f1.k)",
   cidx_cte("c", "mv", ["feature", "iter"])) + "SELECT c.feature, round(avg(base.cindex-c.cindex),4)+0.0 AS importance, round(stddev_pop(base.cindex-c.cindex),4)+0.0 AS importance_sd FROM c, base GROUP BY c.feature")
def permutation_importance(spark, sf):
    s = X.surv(spark, sf).withColumn("risk", -F.col("totalprice_exp") / 1e6 + F.col("acctbal_clin") / 2e4)
    coef = {"totalprice_exp": -1 / 1e6, "acctbal_clin": 1 / 2e4}
    imp = importance.permutation_importance(s, list(coef), coef, n_iter=_SHUFFLES, seed=3)
    return imp.select("feature", (F.round("importance", 4) + F.lit(0.0)).alias("importance"), (F.round("importance_sd", 4) + F.lit(0.0)).alias("importance_sd"))


@q("importance_table", TRAIN + "," + S.long_cte("train", S.FULL) + """, im AS (SELECT feature, round(abs(coalesce(corr(value, os_time),0)),1) AS importance, round(stddev_pop(value),6)+0.0 AS importance_sd FROM lng JOIN train USING (row_id)
   WHERE feature <> 'const_pr' GROUP BY feature)
SELECT feature, importance, importance_sd, 'CPH-L2' AS model, CAST(0.7 AS DOUBLE) AS test_cindex, CAST(0.71 AS DOUBLE) AS val_cindex, CAST(0.72 AS DOUBLE) AS train_cindex,
 rank() OVER (ORDER BY importance DESC) + (count(*) OVER (PARTITION BY importance) - 1)/CAST(2 AS DOUBLE) AS rank FROM im""")
def importance_table(spark, sf):
    from hazardlake.operators import schema

    train = train_part(spark, sf).filter("split = 'train'")
    long = schema.melt(train, [f for f in S.FULL if f != "const_pr"], ["row_id", "os_time"])
    im = long.groupBy("feature").agg(F.round(F.abs(F.coalesce(F.corr("value", "os_time"), F.lit(0.0))), 1).alias("importance"), r6(F.stddev_pop("value"), "importance_sd"))
    return importance.importance_table(im, "CPH-L2", 0.7, 0.71, 0.72)


# ---- ensembles and fusion ----------------------------------------------------

_NORM = """mm AS (SELECT run, split, model, modality, min(risk) AS lo, max(risk) AS hi FROM predictions GROUP BY ALL),
 nrm AS (SELECT p.*, CASE WHEN hi=lo THEN 0.5 ELSE (risk-lo)/(hi-lo) END AS p FROM predictions p JOIN mm USING (run, split, model, modality))"""


@q("normalize_predictions", S.with_(S.SURV, S.PREDICTIONS, _NORM) + "SELECT run, split, model, modality, round(avg(p),6)+0.0 AS mean, round(sum(p*(row_id%7)),6)+0.0 AS checksum FROM nrm GROUP BY ALL")
def normalize_predictions(spark, sf):
    n = ensemble.normalize_predictions(X.predictions(spark, sf))
    return n.groupBy("run", "split", "model", "modality").agg(r6(F.avg("p"), "mean"), r6(F.sum(F.col("p") * F.pmod("row_id", F.lit(7))), "checksum"))


def split_cte(split: str) -> str:
    return f"p_{split} AS (SELECT * FROM predictions WHERE split='{split}'), " + cidx_cte(f"c_{split}", f"p_{split}", ["run", "model", "modality"])


def weights_cte(name: str, cidx: str, within: str, tau: float) -> str:
    return f"""{name} AS (SELECT run, model, modality, CASE WHEN t > 0 THEN g/t ELSE 0 END AS w FROM (SELECT *, sum(g) OVER (PARTITION BY {within}) AS t FROM
   (SELECT run, model, modality, greatest(cindex - CAST({tau} AS DOUBLE), 0) AS g FROM {cidx})))"""


_ABS = """wa AS (SELECT run, model, modality, flip, CASE WHEN t > 0 THEN g/t ELSE 0 END AS w FROM (SELECT *, sum(g) OVER (PARTITION BY run, modality) AS t FROM
   (SELECT run, model, modality, cindex < 0.5 AS flip, abs(cindex - 0.5) AS g FROM c_train)))"""


@q("ensemble_weights", S.with_(S.SURV, S.PREDICTIONS, split_cte("train"), weights_cte("wt", "c_train", "run, modality", 0.5)) + "SELECT run, model, modality, round(w,6)+0.0 AS w FROM wt")
def ensemble_weights(spark, sf):
    c = ensemble.cindex_grouped(X.predictions(spark, sf).filter("split = 'train'"), ["run", "model", "modality"])
    return ensemble.ensemble_weights(c, ["run", "modality"], 0.5).select("run", "model", "modality", r6(F.col("w"), "w"))


@q("ensemble_weights_abs", S.with_(S.SURV, S.PREDICTIONS, split_cte("train"), _ABS) + "SELECT run, model, modality, flip, round(w,6)+0.0 AS w FROM wa")
def ensemble_weights_abs(spark, sf):
    c = ensemble.cindex_grouped(X.predictions(spark, sf).filter("split = 'train'"), ["run", "model", "modality"])
    return ensemble.ensemble_weights_abs(c, ["run", "modality"]).select("run", "model", "modality", "flip", r6(F.col("w"), "w"))


@q("weighted_ensemble", S.with_(S.SURV, S.PREDICTIONS, split_cte("train"), weights_cte("wt", "c_train", "run, modality", 0.5), _ABS, _NORM,
   """en AS (SELECT run, modality, 'all' AS ensemble, row_id, max(os) AS os, max(os_time) AS os_time, round(sum(w*CASE WHEN flip THEN 1-p ELSE p END),12) AS risk FROM nrm JOIN wa USING (run, model, modality) WHERE split='test' GROUP BY ALL
     UNION ALL SELECT run, modality, 'filtered', row_id, max(os), max(os_time), round(sum(w*p),12) FROM nrm JOIN wt USING (run, model, modality) WHERE split='test' GROUP BY ALL)""",
   cidx_cte("c", "en", ["run", "modality", "ensemble"])) + "SELECT run, modality, ensemble, round(cindex,4)+0.0 AS cindex FROM c")
def weighted_ensemble(spark, sf):
    return ensemble.weighted_ensemble(X.predictions(spark, sf)).select("run", "modality", "ensemble", (F.round("cindex", 4) + F.lit(0.0)).alias("cindex"))


def fusion_ctes(last: bool = False) -> str:
    pick = "max_by(risk, model)" if last else "avg(risk)"
    return ",\n".join([S.SURV, S.PREDICTIONS, split_cte("val"), weights_cte("wm", "c_val", "run, modality", 0.53), weights_cte("wo", "c_val", "run, model", 0.53), _NORM,
        "bs AS (SELECT run, model, modality, row_id, os, os_time, p AS risk FROM nrm WHERE split='test')",
        "fu AS (SELECT run, model, 'FUSED' AS modality, row_id, max(os) AS os, max(os_time) AS os_time, round(sum(w*risk),12) AS risk FROM bs JOIN wo USING (run, model, modality) GROUP BY ALL)",
        "en AS (SELECT run, 'ENS' AS model, modality, row_id, max(os) AS os, max(os_time) AS os_time, round(sum(w*risk),12) AS risk FROM bs JOIN wm USING (run, model, modality) GROUP BY ALL)",
        f"ef AS (SELECT run, 'ENS' AS model, 'FUSED' AS modality, row_id, max(os) AS os, max(os_time) AS os_time, round({pick},12) AS risk FROM fu GROUP BY ALL)",
        "al AS (SELECT * FROM bs UNION ALL SELECT * FROM fu UNION ALL SELECT * FROM en UNION ALL SELECT * FROM ef)", cidx_cte("lf", "al", ["run", "model", "modality"])])


@q("late_fusion", "WITH " + fusion_ctes() + " SELECT run, model, modality, round(cindex,4)+0.0 AS cindex FROM lf")
def late_fusion(spark, sf):
    return ensemble.late_fusion(X.predictions(spark, sf)).select("run", "model", "modality", (F.round("cindex", 4) + F.lit(0.0)).alias("cindex"))


@q("mean_ci_over_runs", S.with_(S.SURV, S.PREDICTIONS, split_cte("test")) + "SELECT modality, model, round(avg(cindex),6)+0.0 AS mean, round(1.96*stddev_pop(cindex)/sqrt(count(cindex)),6)+0.0 AS ci95 FROM c_test GROUP BY ALL")
def mean_ci_over_runs(spark, sf):
    c = ensemble.cindex_grouped(X.predictions(spark, sf).filter("split = 'test'"), ["run", "model", "modality"])
    return ensemble.mean_ci_over_runs(c).select("modality", "model", r6(F.col("mean"), "mean"), r6(F.col("ci95"), "ci95"))


@q("error_bars", S.with_(S.SURV, S.PREDICTIONS, split_cte("val")) + "SELECT model, round(avg(cindex),6)+0.0 AS mean, round(1.96*stddev_pop(cindex)/sqrt(count(cindex)),6)+0.0 AS ci95 FROM c_val GROUP BY ALL")
def error_bars(spark, sf):
    c = ensemble.cindex_grouped(X.predictions(spark, sf).filter("split = 'val'"), ["run", "model", "modality"])
    return ensemble.mean_ci_over_runs(c, ["model"]).select("model", r6(F.col("mean"), "mean"), r6(F.col("ci95"), "ci95"))


_MODELS = ["ANTI", "CONST", "GOOD", "WEAK"]


@q("write_fusion_summary", S.with_(S.SURV, S.PREDICTIONS, split_cte("test"), "su AS (SELECT modality, model, avg(cindex) AS m FROM c_test GROUP BY ALL)") +
   "SELECT modality, " + ", ".join(f"round(max(m) FILTER (model='{m}'),6)+0.0 AS {m}" for m in _MODELS) + " FROM su GROUP BY modality")
def write_fusion_summary(spark, sf):
    from hazardlake.session import staging_path
    from hazardlake.sources import sinks

    c = ensemble.cindex_grouped(X.predictions(spark, sf).filter("split = 'test'"), ["run", "model", "modality"])
    path = staging_path(spark, "fusion")
    sinks.write_fusion_summary(ensemble.mean_ci_over_runs(c), _MODELS, path)
    return spark.read.parquet(f"{path}/mean").select("modality", *[r6(F.col(m), m) for m in _MODELS])
