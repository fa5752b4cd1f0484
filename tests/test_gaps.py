"""Rows with missing keys stay; repeated keys do not multiply."""

import pytest
from pyspark.sql import functions as F

from hazardlake.functions.ordered import count_at_most
from hazardlake.operators import boosting, cohort, concordance, cox, neighbors, preprocess, survival, treeboost, unsupervised


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(200).withColumnRenamed("id", "row_id")
    return df.withColumns(
        {
            "subject": F.expr("CASE WHEN row_id % 7 <> 0 THEN row_id % 40 END"),
            "stratum": F.expr("CASE WHEN row_id % 5 <> 0 THEN concat('s', row_id % 3) END"),
            "os": F.expr("CAST(row_id % 2 AS INT)"),
            "os_time": F.expr("CAST(1 + row_id % 23 AS DOUBLE)"),
            "risk": F.expr("CASE WHEN row_id % 4 <> 0 THEN CAST(row_id % 11 AS DOUBLE) END"),
        }
    ).cache()


@pytest.mark.parametrize("split", ["rows", "subjects", "stratified", "validation", "shuffle", "keys"])
def test_rows_in_equal_rows_out(rows, split):
    made = {
        "rows": lambda: cohort.split_rows(rows, "row_id", 0.8, 1),
        "subjects": lambda: cohort.split_subjects(rows, "subject", 0.8, 1),
        "stratified": lambda: cohort.split_stratified(rows, "row_id", ["stratum"], 0.8, 1),
        "validation": lambda: cohort.split_validation(cohort.split_subjects(rows, "subject", 0.8, 1), "row_id", 0.8, 1, subject_col="subject"),
        "shuffle": lambda: cohort.shuffle_targets(rows, "row_id", ["os", "os_time"], 1, ["stratum"]),
        "keys": lambda: cohort.split_rows(rows, "row_id", 0.8, 1, ["stratum"]),
    }[split]()
    assert sorted(r.row_id for r in made.select("row_id").collect()) == list(range(200))


def test_rows_without_stratum_go_to_test(rows):
    got = cohort.split_stratified(rows, "row_id", ["stratum"], 0.8, 1)
    assert {r.split for r in got.filter("stratum IS NULL").collect()} == {"test"}


def test_rows_without_subject_stay_together(rows):
    got = cohort.split_subjects(rows, "subject", 0.8, 1)
    assert got.filter("subject IS NULL").select("split").distinct().count() == 1


def test_cohort_table_with_repeats_and_clashes(spark, rows):
    table = spark.createDataFrame([("s0", "training"), ("s0", "training"), ("s1", "test")], "stratum string, cohort string")
    assert cohort.split_predefined(rows, table, ["stratum"]).count() == rows.filter("stratum IN ('s0', 's1')").count()
    clash = table.union(spark.createDataFrame([("s0", "test")], table.select("stratum").schema.add("cohort", "string")))
    with pytest.raises(Exception, match="two labels"):
        cohort.split_predefined(rows, clash, ["stratum"]).collect()


def test_groups_without_name(rows):
    km = survival.kaplan_meier(rows, "os", "os_time", ["stratum"])
    assert km.filter("stratum IS NULL").count() > 0
    c = {r.stratum: r for r in concordance.concordance_index(rows, "os", "os_time", "risk", ["stratum"]).collect()}
    assert set(c) == {None, "s0", "s1", "s2"}
    assert sum(r.left_out for r in c.values()) == rows.filter("risk IS NULL").count()


def test_more_bins_than_a_thousand(spark):
    long = spark.range(4000).select(F.lit("f").alias("feature"), F.col("id").cast("double").alias("value"))
    bins = preprocess.fit_bins(long, 2000)
    top = preprocess.apply_bins(long, bins, n_features=1).agg(F.max("bin"), F.countDistinct("bin")).first()
    assert tuple(top) == (1999, 2000)
    for n in (0, 1, 2, 3, 1023, 1024, 1025, 5000):
        arr = F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>")
        assert spark.range(1).select(count_at_most(arr, F.lit(n))).first()[0] == n


def test_models_refuse_missing_values(spark):
    rows = spark.createDataFrame([([1.0, None], 1, 2.0), ([2.0, 1.0], 0, 3.0)], "x array<double>, os int, os_time double")
    for fit in (lambda: cox.fit_ridge(rows, ["a", "b"]), lambda: cox.fit_elastic_net(rows, ["a", "b"]), lambda: boosting.fit_componentwise(rows, ["a", "b"]), lambda: treeboost.fit_tree_boost(rows, ["a", "b"], 1)):
        with pytest.raises(ValueError, match="missing"):
            fit()
    with pytest.raises(ValueError, match="depth"):
        treeboost.fit_tree_boost(rows, ["a", "b"], 1, max_depth=0)


def test_label_texts_do_not_collide(spark):
    import random

    rng = random.Random(4)
    data = [(g, i, [rng.random() + (j % 2) * 5], y) for j, (g, y) in enumerate([("a, b", "c"), ("a, b", "d"), ("a", "b, c"), ("a", "d")]) for i in range(j * 40, j * 40 + 40)]
    got = {r.g: r.mi for r in neighbors.mixed_mi(spark.createDataFrame(data, "g string, id long, v array<double>, label string")).collect()}
    assert all(0.7 < v < 1.3 for v in got.values()) and len(got) == 2


def test_divergence_of_repeated_points(spark):
    p = spark.createDataFrame([("g", i, [float(i % 5)]) for i in range(60)], "g string, id long, v array<double>")
    q = spark.createDataFrame([("g", i, [float(i % 5)]) for i in range(100, 180)], "g string, id long, v array<double>")
    assert neighbors.knn_kl_divergence(p, q).first().kl is not None


def test_correlated_groups_with_one_first_member(spark):
    edges = spark.createDataFrame([(0, 2, "x", "a"), (1, 2, "y", "a")], "j int, i int, f1 string, f2 string")
    kept = spark.createDataFrame([(0, True), (1, True), (2, False)], "pos int, kept boolean")
    got = {(r.group, r.member) for r in unsupervised.correlation_groups(edges, kept).collect()}
    assert got == {("group_x", "x"), ("group_x", "a"), ("group_y", "y"), ("group_y", "a")}
