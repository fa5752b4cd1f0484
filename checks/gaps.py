"""Registered queries over rows with missing keys, repeated keys and many bins."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sqltext as S
from checks.queries import q, r6
from hazardlake import fixtures as X
from hazardlake.operators import cohort, concordance, preprocess, schema, survival

#: Every fifth order has no subject, every third no study.
HOLES = """gap AS (SELECT row_id, os, os_time, qty_exp, totalprice_exp, pdl1_status, CASE WHEN row_id % 5 <> 0 THEN subject_id END AS subject_id,
  CASE WHEN row_id % 3 <> 0 THEN study END AS study FROM surv)"""
GAP = S.with_(S.SURV, HOLES)


def gap(spark, sf):
    s = X.surv(spark, sf).select("row_id", "os", "os_time", "qty_exp", "totalprice_exp", "pdl1_status", "subject_id", "study")
    return s.withColumns({"subject_id": F.expr("CASE WHEN row_id % 5 <> 0 THEN subject_id END"), "study": F.expr("CASE WHEN row_id % 3 <> 0 THEN study END")})


@q("split_stratified_gaps", GAP + """SELECT row_id, study, CASE WHEN study IS NOT NULL AND rk <= round(CAST(0.8 AS DOUBLE)*m) THEN 'train' ELSE 'test' END AS split
FROM (SELECT row_id, study, row_number() OVER (PARTITION BY study, pdl1_status ORDER BY md5('5:'||CAST(row_id AS VARCHAR)), row_id) AS rk,
  count(*) OVER (PARTITION BY study, pdl1_status) AS m FROM gap)""")
def split_stratified_gaps(spark, sf):
    """Rows without a stratum go to test; none is lost."""
    return cohort.split_stratified(gap(spark, sf), "row_id", ["study", "pdl1_status"], 0.8, 5).select("row_id", "study", "split")


@q("split_subjects_gaps", GAP + """, so AS (SELECT subject_id, CASE WHEN rk <= floor(CAST(0.8 AS DOUBLE) * m) THEN 'train' ELSE 'test' END AS split FROM
 (SELECT subject_id, row_number() OVER (ORDER BY md5(coalesce('7:'||CAST(subject_id AS VARCHAR), 'null')), subject_id) AS rk, count(*) OVER () AS m FROM (SELECT DISTINCT subject_id FROM gap)))
SELECT row_id, split FROM gap JOIN so ON gap.subject_id IS NOT DISTINCT FROM so.subject_id""")
def split_subjects_gaps(spark, sf):
    """Rows without a subject stay together in one part."""
    return cohort.split_subjects(gap(spark, sf), "subject_id", 0.8, 7).select("row_id", "split")


@q("split_predefined_repeats", S.with_(S.SURV, S.COHORTS) + """SELECT row_id, CASE cohort WHEN 'training' THEN 'train' WHEN 'validation' THEN 'val' ELSE 'test' END AS split
FROM surv JOIN cohorts USING (subject_id, study)""")
def split_predefined_repeats(spark, sf):
    """A cohort table that lists every key twice multiplies no row."""
    twice = X.cohorts(spark, sf).union(X.cohorts(spark, sf))
    return cohort.split_predefined(X.surv(spark, sf), twice, ["subject_id", "study"]).select("row_id", "split")


@q("kaplan_meier_gaps", GAP + """, ev AS (SELECT study, os_time AS time, CAST(sum(os) AS BIGINT) AS events, CAST(sum(count(*)) OVER (PARTITION BY study ORDER BY os_time DESC) AS BIGINT) AS at_risk
   FROM gap GROUP BY study, os_time)
SELECT study, time, at_risk, round(product(1 - CAST(events AS DOUBLE)/at_risk) OVER (PARTITION BY study ORDER BY time),6)+0.0 AS survival FROM ev""")
def kaplan_meier_gaps(spark, sf):
    km = survival.kaplan_meier(gap(spark, sf), "os", "os_time", ["study"])
    return km.select("study", "time", "at_risk", r6(F.col("survival"), "survival"))


@q("concordance_gaps", GAP + """, r AS (SELECT study, os, os_time, CASE WHEN row_id % 4 <> 0 THEN qty_exp END AS risk FROM gap),
p AS (SELECT a.study, CAST(sum(CASE WHEN a.risk > b.risk THEN 1 ELSE 0 END) AS BIGINT) AS concordant, CAST(sum(CASE WHEN a.risk = b.risk THEN 1 ELSE 0 END) AS BIGINT) AS tied, count(*) AS comparable
  FROM r a JOIN r b ON a.os=1 AND a.risk IS NOT NULL AND b.risk IS NOT NULL AND (a.os_time < b.os_time OR (a.os_time = b.os_time AND b.os=0)) AND a.study IS NOT DISTINCT FROM b.study GROUP BY a.study)
SELECT p.study, concordant, tied, comparable, left_out FROM p JOIN (SELECT study, count(*) - count(risk) AS left_out FROM r GROUP BY study) g ON p.study IS NOT DISTINCT FROM g.study""")
def concordance_gaps(spark, sf):
    """A group without a name is a group; rows without risk are counted as left out."""
    rows = gap(spark, sf).withColumn("risk", F.expr("CASE WHEN row_id % 4 <> 0 THEN qty_exp END"))
    return concordance.concordance_index(rows, "os", "os_time", "risk", ["study"]).select("study", "concordant", "tied", "comparable", "left_out")


@q("quantile_bins_many", S.with_(S.SURV, S.long_cte("surv", ["totalprice_exp", "ext_exp"])) + "," + S.quantile_bins("lng", 2000) + "," + """bn AS (SELECT feature, row_id, len(list_filter(es, lambda e: e <= value)) AS bin
 FROM lng JOIN (SELECT feature, list(e ORDER BY e) AS es FROM edges GROUP BY feature) USING (feature) WHERE value IS NOT NULL)
SELECT feature, CAST(bin AS INTEGER) AS bin, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS id_sum FROM bn GROUP BY ALL""")
def quantile_bins_many(spark, sf):
    """Two thousand bins: more than any fixed number of halving steps would find."""
    names = ["totalprice_exp", "ext_exp"]
    long = schema.melt(X.surv(spark, sf).select("row_id", *names), names, ["row_id"])
    b = preprocess.apply_bins(long, preprocess.fit_bins(long, 2000), n_features=2)
    return b.filter("bin IS NOT NULL").groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("id_sum"))
