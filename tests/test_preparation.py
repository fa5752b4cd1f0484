import pytest
from pyspark.sql import functions as F

from hazardlake.operators import cohort, preprocess, schema, unsupervised
from hazardlake.sources import tables


def long_of(spark, data):
    rows = [(i, f, v) for f, vs in data.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "row_id bigint, feature string, value double")


EDGE = {"one": [4.0, 4.0, 4.0, 4.0, 4.0], "gap": [1.0, None, 3.0, 5.0, 7.0], "none": [None] * 5, "tie": [2.0, 1.0, 2.0, 1.0, None]}


def test_fill_values(spark):
    long = long_of(spark, EDGE)
    get = lambda df: {r["feature"]: r["fill"] for r in df.collect()}
    assert get(preprocess.fit_mode(long))["tie"] == 1.0
    assert get(preprocess.fit_median(long))["gap"] == 4.0
    assert get(preprocess.fit_mean(long))["gap"] == 4.0 and get(preprocess.fit_mean(long))["none"] is None
    with pytest.raises(ValueError):
        preprocess.fit_impute(long, {"M": ["gap"]}, {"M": "guess"})


def test_scalers_on_constant_columns(spark):
    long = long_of(spark, EDGE)
    for kind in preprocess.SCALERS:
        out = preprocess.apply_scale(long, preprocess.fit_scale(long, kind), n_features=4)
        assert {r["value"] for r in out.filter("feature = 'one'").collect()} == {0.0}
    with pytest.raises(ValueError):
        preprocess.fit_scale(long, "other")


def test_scaling_twice_changes_nothing(spark):
    long = long_of(spark, {"a": [1.0, 2.0, 4.0, 9.0]})
    once = preprocess.apply_scale(long, preprocess.fit_scale(long, "standardize"))
    twice = preprocess.apply_scale(once, preprocess.fit_scale(once, "standardize"))
    a = [r["value"] for r in once.orderBy("row_id").collect()]
    b = [r["value"] for r in twice.orderBy("row_id").collect()]
    assert all(abs(x - y) < 1e-12 for x, y in zip(a, b))


def test_bins_drop_repeated_edges(spark):
    long = long_of(spark, {"a": [1.0] * 6 + [2.0, 3.0, 3.0, 3.0], "one": [4.0] * 10})
    edges = {r["feature"]: r["edges"] for r in preprocess.fit_bins(long, 5).collect()}
    assert edges["one"] == [] and all(e > 1.0 for e in edges["a"]) and all(e < 3.0 for e in edges["a"])
    bins = preprocess.apply_bins(long, preprocess.fit_bins(long, 5)).filter("feature = 'a'").orderBy("row_id").collect()
    assert bins[0]["bin"] == 0 and bins[-1]["bin"] == len(edges["a"])


def test_multi_key_cohort_has_no_concatenation_clash(spark):
    df = spark.createDataFrame([("a_b", "c"), ("a", "b_c"), ("x", "y")], "k1 string, k2 string")
    coh = spark.createDataFrame([("a_b", "c", "training")], "k1 string, k2 string, cohort string")
    assert [tuple(r) for r in cohort.cohort_members(df, coh, ["k1", "k2"], "training").collect()] == [("a_b", "c")]


def test_predefined_split_needs_cohorts(spark):
    with pytest.raises(ValueError):
        cohort.split_predefined(spark.range(3), None, ["id"])


def test_subject_split_keeps_subjects_together(spark):
    df = spark.range(900).select("id", F.pmod("id", F.lit(90)).alias("subject_id"))
    out = cohort.split_subjects(df, "subject_id", 0.8, 1)
    assert out.groupBy("subject_id").agg(F.countDistinct("split").alias("n")).filter("n > 1").isEmpty()
    assert out.filter("split = 'train'").select("subject_id").distinct().count() == 72
    val = cohort.split_validation(out, "id", 0.8, 1, subject_col="subject_id")
    assert val.count() == 900 and val.groupBy("subject_id").agg(F.countDistinct("split").alias("n")).filter("n > 1").isEmpty()


def test_row_and_stratified_split_sizes(spark):
    df = spark.range(101).select("id", (F.col("id") % 3).alias("s"))
    assert cohort.split_rows(df, "id", 0.8, 2).filter("split = 'test'").count() == 21
    per = {r["s"]: r["n"] for r in cohort.split_stratified(df, "id", ["s"], 0.5, 2).filter("split = 'train'").groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert per == {0: 17, 1: 17, 2: 17}


def test_kfold_is_contiguous_and_even(spark):
    out = cohort.kfold(spark.range(13), "id", 5).orderBy("id").collect()
    folds = [r["fold"] for r in out]
    assert folds == sorted(folds) and [folds.count(f) for f in range(5)] == [3, 3, 3, 2, 2]


def test_binarize_time(spark):
    df = spark.createDataFrame([(1, 10.0), (0, 10.0), (1, 400.0), (0, 400.0)], "os int, t double")
    assert [r["label"] for r in cohort.binarize_time(df, "os", "t").collect()] == [1, None, 0, 0]


def test_suffixes_do_not_clash():
    got = schema.features_by_modality(["a_mut", "b_smut", "id"], {"MUT": "_mut", "SMUT": "_smut"})
    assert got == {"MUT": ["a_mut"], "SMUT": ["b_smut"]}


def test_forced_column(spark):
    src = spark.createDataFrame([(1, 2.0, "hi")], "row_id int, a_exp double, pd string")
    slim = src.select("row_id", "a_exp")
    assert "pd" in schema.forced_column(slim, src, "row_id", "pd", True, ["EXPRESSION"]).columns
    assert "pd" not in schema.forced_column(src, src, "row_id", "pd", False, ["CLINICAL"]).columns


def test_reader(spark, tmp_path):
    p = str(tmp_path / "t.csv")
    spark.createDataFrame([(1, 2.5)], "a int, b double").withColumnRenamed("a", "Unnamed: 0").write.csv(p, header=True)
    assert tables.read_table(spark, p).columns == ["b"]
    with pytest.raises(ValueError, match="Unsupported file format"):
        tables.read_table(spark, "x.xlsx")


CHAIN = [(i, float(a), float(a + b), float(b + c)) for i, (a, b, c) in enumerate([(0, 1, 5), (1, 0, 2), (2, 3, 0), (3, 2, 4), (4, 5, 1), (5, 4, 3), (6, 2, 2)])]


@pytest.mark.parametrize("block", [1, 2, 4, 1024])
def test_correlated_sweep_in_blocks(spark, block):
    # 0-1, 1-2, 2-3 chained: dropping 1 keeps 2, which drops 3
    edges = spark.createDataFrame([(1, 0, "f0", "f1", 0.9), (2, 1, "f1", "f2", 0.9), (3, 2, "f2", "f3", 0.9), (5, 4, "f4", "f5", 0.8)], "i int, j int, f1 string, f2 string, r double")
    sweep = {r["pos"]: r["kept"] for r in unsupervised.drop_correlated(edges, 6, block).collect()}
    assert sweep == {0: True, 1: False, 2: True, 3: False, 4: True, 5: False}
    if block < 1024:
        return
    groups = unsupervised.correlation_groups(edges, unsupervised.drop_correlated(edges, 6))
    assert {tuple(r) for r in groups.collect()} == {(f"group_f{a}", f"f{b}") for a, b in ((0, 0), (0, 1), (2, 2), (2, 3), (4, 4), (4, 5))}
    # a dropped feature joins the group of every kept earlier neighbour
    more = edges.unionByName(spark.createDataFrame([(3, 0, "f0", "f3", 0.9)], edges.schema))
    both = unsupervised.correlation_groups(more, unsupervised.drop_correlated(more, 6)).filter("member = 'f3'")
    assert {r["group"] for r in both.collect()} == {"group_f0", "group_f2"}


def test_gram_correlation_matches_corr(spark):
    df = spark.createDataFrame([(a, b, c, 1.0) for _, a, b, c in CHAIN], "a double, b double, c double, k double")
    df = df.withColumn("b", F.when(F.col("a") == 2, None).otherwise(F.col("b")))
    vec = df.select(F.array("a", "b", "c", "k").alias("x"))
    got = {(r["f1"], r["f2"]): (r["r"], r["n"]) for r in unsupervised.pearson_pairs(vec, ["a", "b", "c", "k"]).collect()}
    for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
        e = df.filter(f"{x} IS NOT NULL AND {y} IS NOT NULL").agg(F.corr(x, y), F.count("*")).first()
        assert abs(got[x, y][0] - e[0]) < 1e-12 and got[x, y][1] == e[1]
    assert got["a", "k"][0] is None
