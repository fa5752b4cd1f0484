"""Registered queries: reading, cohorts, preprocessing and screening."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sqltext as S
from hazardlake import fixtures as X
from hazardlake.functions.ordered import hash_int, hash_rank
from hazardlake.operators import cohort, concordance, information, preprocess, schema, survival, unsupervised
from hazardlake.session import materialize, staging_path
from hazardlake.sources import tables

QUERIES: dict = {}
SQL: dict[str, str] = {}
IDS = ["row_id", "os", "os_time"]


def q(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def r6(c, name: str):
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


def by_modality(columns):
    return schema.features_by_modality(columns, X.SUFFIXES)


def dictionary(df):
    """Numeric features only, in table order."""
    return schema.feature_dictionary(df.select(*S.FULL), by_modality(S.FULL))


def train_part(spark, sf, seed=7, fraction=0.8):
    return cohort.split_subjects(X.surv(spark, sf), "subject_id", fraction, seed)


def long_train(spark, sf, features=S.FULL):
    train = train_part(spark, sf).filter("split = 'train'").select("row_id", *features)
    return schema.melt(materialize(train), features, ["row_id"])


TRAIN = S.with_(S.SURV, S.subject_split(7, 0.8), "train AS (SELECT surv.* FROM surv JOIN split_of USING (subject_id) WHERE split='train')")
TRAIN_LONG = TRAIN + ",\n" + S.long_cte("train", S.FULL) + "\n"
ALL_LONG = S.with_(S.SURV, S.long_cte("surv", S.FULL))
MED = "med AS (SELECT feature, quantile_cont(value, 0.5) AS fill FROM lng WHERE value IS NOT NULL GROUP BY feature)"

# ---- reading and projecting --------------------------------------------------

_SCAN_COLS = "o_orderkey AS row_id, o_custkey AS subject_id, o_totalprice AS totalprice_exp, o_orderstatus AS status_clin"


@q("scan_csv", f"SELECT {_SCAN_COLS} FROM orders")
def scan_csv(spark, sf):
    src = X.table(spark, sf, "orders").selectExpr(*_SCAN_COLS.split(", "))
    path = staging_path(spark, "orders") + ".csv"
    src.write.csv(path, header=True)
    return tables.read_table(spark, path, schema=src.schema)


@q("scan_parquet", "SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice),6)+0.0 AS mean_price FROM orders GROUP BY 1")
def scan_parquet(spark, sf):
    df = tables.read_table(spark, f"{sf}/orders.parquet")
    return df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("o_totalprice"), "mean_price"))


@q("drop_unnamed", "SELECT c_custkey, c_acctbal FROM customer")
def drop_unnamed(spark, sf):
    df = X.table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("Unnamed: 0"), "c_acctbal")
    return schema.drop_unnamed(df)


@q("read_cohorts", S.with_(S.SURV, S.COHORTS) + "SELECT cohort, count(*) AS n, CAST(sum(subject_id) AS BIGINT) AS id_sum FROM cohorts GROUP BY cohort")
def read_cohorts(spark, sf):
    c = tables.read_cohorts(X.cohorts(spark, sf), ["training", "validation", "test"])
    return c.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.sum("subject_id").alias("id_sum"))


@q("modality_features", ALL_LONG + "," + S.features_cte(S.FULL) + """
SELECT d.feature, modality, CAST(pos AS INTEGER) AS pos, count(value) AS n_values FROM dict d JOIN lng USING (feature) GROUP BY ALL""")
def modality_features(spark, sf):
    s = X.surv(spark, sf)
    counts = schema.melt(s, S.FULL, ["row_id"]).groupBy("feature").agg(F.count("value").alias("n_values"))
    return dictionary(s).join(counts, "feature")


@q("feature_allowlist", ALL_LONG + """SELECT feature, round(avg(value),6)+0.0 AS mean FROM lng
WHERE feature IN ('qty_exp','ext_exp','disc_mut','tax_mut','nret_mut','acctbal_clin','const_pr','unit_pr') GROUP BY feature""")
def feature_allowlist(spark, sf):
    s = X.surv(spark, sf)
    feats = schema.features_by_modality(S.FULL, X.SUFFIXES, {"EXPRESSION": ["qty_exp", "ext_exp", "disc_mut"]})
    names = [f for fs in feats.values() for f in fs]
    return schema.melt(s, names, ["row_id"]).groupBy("feature").agg(r6(F.avg("value"), "mean"))


@q("filter_types", S.with_(S.SURV) + "SELECT type, count(*) AS n FROM surv WHERE type IN ('BUILDING','MACHINERY') GROUP BY type")
def filter_types(spark, sf):
    return cohort.filter_types(X.surv(spark, sf), ["BUILDING", "MACHINERY"]).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@q("expand_all_types", S.with_(S.SURV) + "SELECT type, count(*) AS n FROM surv WHERE type IN ('BUILDING','AUTOMOBILE') GROUP BY type")
def expand_all_types(spark, sf):
    df = cohort.filter_types(X.surv(spark, sf), ["ALL"], all_types=["BUILDING", "AUTOMOBILE"])
    return df.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@q("select_modalities", S.with_(S.SURV) + "SELECT row_id, os, os_time, disc_mut, tax_mut, nret_mut FROM surv")
def select_modalities(spark, sf):
    s = X.surv(spark, sf)
    return schema.keep_modalities(s, by_modality(S.FULL), ["MUTATION"], IDS).select(
        *IDS, "disc_mut", "tax_mut", "nret_mut"
    )


@q("select_features", S.with_(S.SURV) + "SELECT row_id, os, os_time, qty_exp, tax_mut FROM surv")
def select_features(spark, sf):
    return schema.keep_features(X.surv(spark, sf), ["qty_exp", "tax_mut"], IDS)


@q("forced_column", S.with_(S.SURV) + "SELECT row_id, os, os_time, qty_exp, pdl1_status FROM surv")
def forced_column(spark, sf):
    s = X.surv(spark, sf)
    return schema.forced_column(schema.keep_features(s, ["qty_exp"], IDS), s, "row_id", "pdl1_status", True, ["EXPRESSION"])


@q("modality_slice", S.with_(S.SURV, S.subject_split(7, 0.8)) + """SELECT row_id, os, os_time, type, split, disc_mut, tax_mut, nret_mut
FROM surv JOIN split_of USING (subject_id)""")
def modality_slice(spark, sf):
    return schema.modality_slice(train_part(spark, sf), by_modality(S.FULL), "MUTATION", [*IDS, "type", "split"])


@q("drop_incomplete_rows", S.with_(S.SURV) + "SELECT type, count(*) AS n FROM surv WHERE qty_exp IS NOT NULL AND nlines_exp IS NOT NULL AND ext_exp IS NOT NULL GROUP BY type")
def drop_incomplete_rows(spark, sf):
    cols = preprocess.rows_to_drop(by_modality(S.FULL), {"EXPRESSION": "drop", "MUTATION": "mean"})
    return cohort.drop_incomplete(X.surv(spark, sf), cols).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@q("split_high_low", S.with_(S.SURV, S.PREDICTIONS) + """SELECT run, model, risk_group, count(*) AS n, round(avg(os_time),6)+0.0 AS mean_time FROM
 (SELECT p.*, CASE WHEN risk <= med THEN 'low' ELSE 'high' END AS risk_group FROM predictions p JOIN
   (SELECT run, model, modality, quantile_cont(risk, 0.5) AS med FROM predictions WHERE split='test' GROUP BY ALL) m USING (run, model, modality) WHERE split='test')
 GROUP BY ALL""")
def split_high_low(spark, sf):
    p = X.predictions(spark, sf).filter("split = 'test'")
    g = cohort.high_low_groups(p, "risk", ["run", "model", "modality"])
    return g.groupBy("run", "model", "risk_group").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("os_time"), "mean_time"))


@q("filter_prediction_type", S.with_(S.SURV, S.PREDICTIONS) + "SELECT run, model, count(*) AS n FROM predictions WHERE type='BUILDING' GROUP BY ALL")
def filter_prediction_type(spark, sf):
    return cohort.filter_types(X.predictions(spark, sf), ["BUILDING"]).groupBy("run", "model").agg(F.count(F.lit(1)).alias("n"))


# ---- cohorts and splits ------------------------------------------------------

@q("cohort_semi_join", S.with_(S.SURV, S.COHORTS) + "SELECT row_id FROM surv WHERE subject_id IN (SELECT subject_id FROM cohorts WHERE cohort='training')")
def cohort_semi_join(spark, sf):
    return cohort.cohort_members(X.surv(spark, sf), X.cohorts(spark, sf), ["subject_id"], "training").select("row_id")


@q("cohort_semi_join_multi", S.with_(S.SURV, S.COHORTS) + "SELECT row_id FROM surv WHERE EXISTS (SELECT 1 FROM cohorts c WHERE c.subject_id=surv.subject_id AND c.study=surv.study AND cohort='test')")
def cohort_semi_join_multi(spark, sf):
    return cohort.cohort_members(X.surv(spark, sf), X.cohorts(spark, sf), ["subject_id", "study"], "test").select("row_id")


@q("subject_semi_join", S.with_(S.SURV, S.subject_split(7, 0.8)) + "SELECT split, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS id_sum FROM surv JOIN split_of USING (subject_id) GROUP BY split")
def subject_semi_join(spark, sf):
    return train_part(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("id_sum"))


@q("complement_rows", S.with_(S.SURV, S.subject_split(7, 0.8)) + "SELECT row_id FROM surv JOIN split_of USING (subject_id) WHERE split='test'")
def complement_rows(spark, sf):
    s = train_part(spark, sf)
    return cohort.rows_not_in(s, s.filter("split = 'train'"), "row_id").select("row_id")


@q("add_column_by_row", S.with_(S.SURV) + "SELECT row_id, qty_exp, tax_mut FROM surv")
def add_column_by_row(spark, sf):
    s = X.surv(spark, sf)
    return schema.add_by_row(s.select("row_id", "qty_exp"), s.select("row_id", "tax_mut"), "row_id")


def _row_rank(seed, keys="", src="surv"):
    part = f"PARTITION BY {keys} " if keys else ""
    return f"row_number() OVER ({part}ORDER BY md5('{seed}:'||CAST(row_id AS VARCHAR)), row_id)"


@q("split_rows", S.with_(S.SURV) + f"""SELECT row_id, CASE WHEN rk <= m - ceil(CAST({1 - 0.8!r} AS DOUBLE)*m) THEN 'train' ELSE 'test' END AS split
FROM (SELECT row_id, {_row_rank(11)} AS rk, count(*) OVER () AS m FROM surv)""")
def split_rows(spark, sf):
    return cohort.split_rows(X.surv(spark, sf).select("row_id"), "row_id", 0.8, 11).select("row_id", "split")


@q("split_subjects", S.with_(S.SURV, S.subject_split(7, 0.8)) + "SELECT DISTINCT subject_id, split FROM split_of")
def split_subjects(spark, sf):
    return train_part(spark, sf).select("subject_id", "split").distinct()


@q("split_stratified", S.with_(S.SURV) + f"""SELECT row_id, study, CASE WHEN rk <= round(CAST(0.8 AS DOUBLE)*m) THEN 'train' ELSE 'test' END AS split
FROM (SELECT row_id, study, {_row_rank(5, 'study, pdl1_status')} AS rk, count(*) OVER (PARTITION BY study, pdl1_status) AS m FROM surv)""")
def split_stratified(spark, sf):
    s = X.surv(spark, sf).select("row_id", "study", "pdl1_status")
    return cohort.split_stratified(s, "row_id", ["study", "pdl1_status"], 0.8, 5).select("row_id", "study", "split")


@q("split_predefined", S.with_(S.SURV, S.COHORTS) + """SELECT row_id, CASE cohort WHEN 'training' THEN 'train' WHEN 'validation' THEN 'val' ELSE 'test' END AS split
FROM surv JOIN cohorts USING (subject_id, study)""")
def split_predefined(spark, sf):
    return cohort.split_predefined(X.surv(spark, sf), X.cohorts(spark, sf), ["subject_id", "study"]).select("row_id", "split")


@q("split_validation", S.with_(S.SURV, S.subject_split(7, 0.8), "tr AS (SELECT surv.* FROM surv JOIN split_of USING (subject_id) WHERE split='train')",
   S.subject_split(7, 0.8, "tr", "inner_of")) + """SELECT row_id, CASE WHEN o.split='test' THEN 'test' WHEN i.split='test' THEN 'val' ELSE 'train' END AS split
FROM surv JOIN split_of o USING (subject_id) LEFT JOIN inner_of i USING (subject_id)""")
def split_validation(spark, sf):
    s = train_part(spark, sf).select("row_id", "subject_id", "split")
    return cohort.split_validation(s, "row_id", 0.8, 7, subject_col="subject_id").select("row_id", "split")


_SEEDS = "(SELECT seed, row_number() OVER (ORDER BY md5('42:'||CAST(seed AS VARCHAR)), seed) AS run FROM (SELECT unnest(range(1,1000)) AS seed))"


@q("repeat_runs", S.with_(S.SURV) + f"""SELECT CAST(run AS INTEGER) AS run, CAST(seed AS INTEGER) AS seed, row_id, CASE WHEN rk <= m - ceil(CAST({1 - 0.8!r} AS DOUBLE)*m) THEN 'train' ELSE 'test' END AS split
FROM (SELECT run, seed, row_id, row_number() OVER (PARTITION BY run ORDER BY md5(CAST(seed AS VARCHAR)||':'||CAST(row_id AS VARCHAR)), row_id) AS rk, count(*) OVER (PARTITION BY run) AS m
  FROM surv, {_SEEDS} s WHERE run <= 3)""")
def repeat_runs(spark, sf):
    seeds = [r["seed"] for r in tables.draw_seeds(spark, 3, 42).orderBy("run").collect()]
    runs = cohort.repeat_runs(X.surv(spark, sf).select("row_id"), seeds)
    return cohort.split_rows(runs, "row_id", 0.8, F.col("seed"), ["run"]).select("run", "seed", "row_id", "split")


@q("kfold", S.with_(S.SURV) + "SELECT row_id, CAST(ntile(5) OVER (ORDER BY row_id) - 1 AS INTEGER) AS fold FROM surv")
def kfold(spark, sf):
    return cohort.kfold(X.surv(spark, sf).select("row_id"), "row_id", 5)


_HF = S.h("'3:'||CAST(row_id AS VARCHAR)")


@q("hash_folds", S.with_(S.SURV) + f"SELECT row_id, CAST({_HF} % 5 AS INTEGER) AS fold FROM surv")
def hash_folds(spark, sf):
    return cohort.hash_folds(X.surv(spark, sf).select("row_id"), "row_id", 5, 3)


@q("holdout_fraction", S.with_(S.SURV) + f"""SELECT split, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS id_sum FROM
(SELECT row_id, CASE WHEN rk <= m - ceil(CAST({1 - 0.85!r} AS DOUBLE)*m) THEN 'train' ELSE 'test' END AS split
FROM (SELECT row_id, {_row_rank(4)} AS rk, count(*) OVER () AS m FROM surv)) GROUP BY split""")
def holdout_fraction(spark, sf):
    s = cohort.split_rows(X.surv(spark, sf).select("row_id"), "row_id", 0.85, 4)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("id_sum"))


@q("shuffle_targets", S.with_(S.SURV) + """SELECT a.row_id, b.os, b.os_time FROM
 (SELECT row_id, row_number() OVER (ORDER BY md5('9:to:'||CAST(row_id AS VARCHAR)), row_id) AS k FROM surv) a JOIN
 (SELECT os, os_time, row_number() OVER (ORDER BY md5('9:from:'||CAST(row_id AS VARCHAR)), row_id) AS k FROM surv) b USING (k)""")
def shuffle_targets(spark, sf):
    return cohort.shuffle_targets(X.surv(spark, sf).select("row_id", "os", "os_time"), "row_id", ["os", "os_time"], 9)


@q("binarize_time", S.with_(S.SURV) + "SELECT row_id, CASE WHEN os_time > 365 THEN 0 WHEN os = 1 THEN 1 END AS label FROM surv")
def binarize_time(spark, sf):
    return cohort.binarize_time(X.surv(spark, sf), "os", "os_time", 365.0).select("row_id", "label")


# ---- preprocessing -----------------------------------------------------------

def _impute_query(mode):
    def run(spark, sf):
        train = long_train(spark, sf)
        fills = preprocess.fit_impute(train, {"ALL": S.FULL}, {"ALL": mode})
        whole = schema.melt(X.surv(spark, sf), S.FULL, ["row_id"])
        done = preprocess.apply_impute(whole, fills, len(S.FULL))
        return done.groupBy("feature").agg(F.count("value").alias("n"), r6(F.avg("value"), "mean"), r6(F.sum(F.col("value") * F.pmod("row_id", F.lit(7))) / 1e6, "checksum"))

    return run


def _impute_sql(fill_sql):
    return TRAIN_LONG + ",\nwhole AS (SELECT * FROM (" + S.with_(S.long_cte("surv", S.FULL, name="w")) + "SELECT * FROM w)),\n" + f"fills AS ({fill_sql})\n" + """
SELECT feature, count(coalesce(value, fill)) AS n, round(avg(coalesce(value, fill)),6)+0.0 AS mean, round(sum(coalesce(value, fill)*(row_id % 7))/1e6,6)+0.0 AS checksum
FROM whole JOIN fills USING (feature) GROUP BY feature"""


_FILL_SQL = {
    "zeroes": "SELECT DISTINCT feature, CAST(0 AS DOUBLE) AS fill FROM lng",
    "median": "SELECT feature, quantile_cont(value, 0.5) AS fill FROM lng WHERE value IS NOT NULL GROUP BY feature",
    "mean": "SELECT feature, avg(value) AS fill FROM lng GROUP BY feature",
    "mode": "SELECT feature, value AS fill FROM (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, value) AS k FROM lng WHERE value IS NOT NULL GROUP BY feature, value) WHERE k=1",
}
for _m, _name in (("zeroes", "impute_zero"), ("median", "impute_median"), ("mean", "impute_mean"), ("mode", "impute_mode")):
    q(_name, _impute_sql(_FILL_SQL[_m]))(_impute_query(_m))


@q("impute_dispatch", TRAIN_LONG + f""", fills AS (
 SELECT * FROM ({_FILL_SQL['median']}) WHERE feature LIKE '%\\_exp' ESCAPE '\\'
 UNION ALL SELECT * FROM ({_FILL_SQL['mode']}) WHERE feature LIKE '%\\_mut' ESCAPE '\\'
 UNION ALL SELECT * FROM ({_FILL_SQL['mean']}) WHERE feature LIKE '%\\_pr' ESCAPE '\\')
SELECT feature, round(fill,6)+0.0 AS fill FROM fills""")
def impute_dispatch(spark, sf):
    modes = {"EXPRESSION": "median", "MUTATION": "mode", "PYRADIOMICS": "mean", "CLINICAL": None}
    return preprocess.fit_impute(long_train(spark, sf), by_modality(S.FULL), modes).select("feature", r6(F.col("fill"), "fill"))


_SCALE_SQL = {
    "standardize": "SELECT feature, avg(value) AS center, CASE WHEN min(value)=max(value) THEN 1 ELSE stddev_pop(value) END AS scale FROM lng GROUP BY feature",
    "minmax_scale": "SELECT feature, min(value) AS center, CASE WHEN max(value)=min(value) THEN 1 ELSE max(value)-min(value) END AS scale FROM lng GROUP BY feature",
    "robust_scale": """SELECT feature, quantile_cont(value,0.5) AS center, CASE WHEN quantile_cont(value,0.75)=quantile_cont(value,0.25) THEN 1
  ELSE quantile_cont(value,0.75)-quantile_cont(value,0.25) END AS scale FROM lng WHERE value IS NOT NULL GROUP BY feature""",
}


def _scale_query(kind):
    def run(spark, sf):
        scales = preprocess.fit_scale(long_train(spark, sf), kind)
        whole = schema.melt(X.surv(spark, sf), S.FULL, ["row_id"])
        done = preprocess.apply_scale(whole, scales, n_features=len(S.FULL))
        return done.groupBy("feature").agg(r6(F.avg("value"), "mean"), r6(F.min("value"), "lo"), r6(F.max("value"), "hi"), r6(F.sum(F.col("value") * F.pmod("row_id", F.lit(7))) / 1e6, "checksum"))

    return run


def _scale_sql(fit):
    return TRAIN_LONG + ",\nwhole AS (SELECT * FROM (" + S.with_(S.long_cte("surv", S.FULL, name="w")) + "SELECT * FROM w)),\n" + f"st AS ({fit})\n" + """
SELECT feature, round(avg(z),6)+0.0 AS mean, round(min(z),6)+0.0 AS lo, round(max(z),6)+0.0 AS hi, round(sum(z*(row_id % 7))/1e6,6)+0.0 AS checksum
FROM (SELECT feature, row_id, (value-center)/scale AS z FROM whole JOIN st USING (feature)) GROUP BY feature"""


for _k, _name in (("standardize", "standardize"), ("minmax_scale", "minmax_scale"), ("robust_scale", "robust_scale")):
    q(_name, _scale_sql(_SCALE_SQL[_k]))(_scale_query(_k))


@q("scale_dispatch", TRAIN_LONG + f""", st AS (SELECT * FROM ({_SCALE_SQL['standardize']}) WHERE feature LIKE '%\\_exp' ESCAPE '\\'
 UNION ALL SELECT * FROM ({_SCALE_SQL['minmax_scale']}) WHERE feature LIKE '%\\_mut' ESCAPE '\\')
SELECT feature, round(center,6)+0.0 AS center, round(scale,6)+0.0 AS scale FROM st""")
def scale_dispatch(spark, sf):
    st = preprocess.fit_scales(long_train(spark, sf), by_modality(S.FULL), {"EXPRESSION": "standardize", "MUTATION": "minmax_scale"})
    return st.select("feature", r6(F.col("center"), "center"), r6(F.col("scale"), "scale"))


@q("minmax_per_split", S.with_(S.SURV, S.subject_split(7, 0.8), "sp AS (SELECT surv.*, split FROM surv JOIN split_of USING (subject_id))",
   S.long_cte("sp", S.FULL, "row_id, split")) + """SELECT split, feature, round(avg(z),6)+0.0 AS mean, round(max(z),6)+0.0 AS hi FROM
 (SELECT l.split, l.feature, (value-lo)/CASE WHEN hi=lo THEN 1 ELSE hi-lo END AS z FROM lng l JOIN
   (SELECT split, feature, min(value) AS lo, max(value) AS hi FROM lng GROUP BY ALL) s ON l.split=s.split AND l.feature=s.feature) GROUP BY ALL""")
def minmax_per_split(spark, sf):
    long = schema.melt(train_part(spark, sf), S.FULL, ["row_id", "split"])
    st = preprocess.fit_scale(long, "minmax_scale", ["split"])
    done = preprocess.apply_scale(long, st, ["split"], 3 * len(S.FULL))
    return done.groupBy("split", "feature").agg(r6(F.avg("value"), "mean"), r6(F.max("value"), "hi"))


@q("quantile_bins", TRAIN_LONG + "," + S.quantile_bins("lng", 10) + "," + S.binned("lng") + "SELECT feature, bin, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS id_sum FROM binned GROUP BY ALL")
def quantile_bins(spark, sf):
    long = long_train(spark, sf)
    b = preprocess.apply_bins(long, preprocess.fit_bins(long, 10), n_features=len(S.FULL))
    return b.filter("bin IS NOT NULL").groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("id_sum"))


@q("equal_width_bins", TRAIN_LONG + """, mm AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM lng GROUP BY feature)
SELECT feature, CAST(bin AS INTEGER) AS bin, count(*) AS n FROM (SELECT feature, CASE WHEN hi=lo THEN 0 ELSE
  len(list_filter([lo+(hi-lo)/10*i FOR i IN range(1,10)], lambda e: e <= value)) END AS bin FROM lng JOIN mm USING (feature) WHERE value IS NOT NULL) GROUP BY ALL""")
def equal_width_bins(spark, sf):
    long = long_train(spark, sf)
    b = preprocess.apply_bins(long, preprocess.fit_bins(long, 10, "uniform"), n_features=len(S.FULL))
    return b.filter("bin IS NOT NULL").groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))


@q("ordinal_encode", TRAIN + """, lv AS (SELECT row_id, unnest(['status_clin','nation_clin','acctbal_clin']) AS feature,
   unnest([status_clin, nation_clin, printf('%020.4f', acctbal_clin + 100000)]) AS level FROM train),
 codes AS (SELECT row_id, feature, dense_rank() OVER (PARTITION BY feature ORDER BY level) - 1 AS code FROM lv WHERE level IS NOT NULL)
SELECT feature, count(*) AS n, CAST(max(code) AS INTEGER) AS top, CAST(sum(code*(row_id%7)) AS BIGINT) AS checksum FROM codes GROUP BY feature""")
def ordinal_encode(spark, sf):
    train = train_part(spark, sf).filter("split = 'train'")
    text = schema.melt_text(train, ["status_clin", "nation_clin"], ["row_id"])
    num = schema.melt(train, ["acctbal_clin"], ["row_id"])
    a = preprocess.apply_levels(text, preprocess.fit_levels(text))
    b = preprocess.apply_levels(num, preprocess.fit_levels(num, "value"), "value")
    coded = a.unionByName(b).filter("code IS NOT NULL")
    return coded.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.max("code").alias("top"), F.sum(F.col("code") * F.pmod("row_id", F.lit(7))).alias("checksum")
    )


_TARGET = "tl AS (SELECT row_id, 't' AS feature, os_time AS value FROM train)"


def target_cte(n_bins=10):
    return ",\n" + _TARGET + ",\n" + S.quantile_bins("tl", n_bins, name="te") + ",\n" + S.binned("tl", "te", name="tb") + ",\ny AS (SELECT row_id, bin AS y FROM tb)\n"


@q("target_discretize", TRAIN + target_cte() + """, mm AS (SELECT quantile_cont(os_time, 0.5) AS m FROM train)
SELECT y, CAST(os_time > m AS INTEGER) AS late, count(*) AS n, round(sum(os_time),6)+0.0 AS total FROM y JOIN train USING (row_id), mm GROUP BY ALL""")
def target_discretize(spark, sf):
    t = train_part(spark, sf).filter("split = 'train'").select("row_id", "os_time")
    d = preprocess.discretize_target(t, "os_time", "discrete")
    d = preprocess.discretize_target(d, "os_time", "median_binarized", out="late")
    d = preprocess.discretize_target(d, "os_time", "continuous", out="raw")
    return d.groupBy("y", "late").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("raw"), "total"))
