import itertools

import pytest
from pyspark.sql import functions as F

from hazardlake.operators import information, preprocess, schema, stability


def packed(spark, columns, y):
    rows = [([int(c[i]) for c in columns], int(y[i]), 1) for i in range(len(y))]
    return spark.createDataFrame(rows, "bins array<int>, y int, w bigint")


XOR = list(itertools.product([0, 1], repeat=3))
A, B, C = ([r[i] for r in XOR] for i in range(3))
Y = [a ^ b for a, b in zip(A, B)]


def test_information_with_itself_is_entropy(spark):
    rows = [("f", x, x, 1) for x in [0, 0, 1, 2, 2, 2]]
    j = spark.createDataFrame(rows, "feature string, x int, y int, c bigint").groupBy("feature", "x", "y").agg(F.sum("c").alias("c"))
    r = information.mutual_information(j).first()
    assert abs(r["mi"] - r["entropy_x"]) < 1e-12 and abs(r["su"] - 1) < 1e-12 and abs(r["cond_entropy"]) < 1e-12


def test_constant_feature_has_no_information(spark):
    j = spark.createDataFrame([("k", 0, 0, 3), ("k", 0, 1, 5)], "feature string, x int, y int, c bigint")
    r = information.mutual_information(j).first()
    assert r["mi"] == 0.0 and r["entropy_x"] == 0.0


def test_xor_needs_joint_information(spark):
    data = packed(spark, [A, C, B], Y)
    mim = [p["feature"] for p in information.greedy_select(data, ["a", "c", "b"], "MIM", 2)]
    jmi = [p["feature"] for p in information.greedy_select(data, ["a", "c", "b"], "JMI", 2)]
    assert mim == ["a", "c"] and jmi == ["a", "b"]


@pytest.mark.parametrize("method", list(information.RULES))
def test_more_wanted_than_there_are(spark, method):
    picks = information.greedy_select(packed(spark, [A, B, C], Y), ["a", "b", "c"], method, 5)
    assert sorted(p["feature"] for p in picks) == ["a", "b", "c"]


def test_without_k_stops_after_first_negative_score(spark):
    twin = information.greedy_select(packed(spark, [Y, Y, C], Y), ["y1", "y2", "c"], "MIFS", None, beta=2.0)
    assert [p["feature"] for p in twin] == ["y1", "c", "y2"] and twin[-1]["score"] < 0


def test_fcbf_removes_copies(spark):
    out = information.fcbf(packed(spark, [Y, Y, C], Y), ["y1", "y2", "c"])
    assert [p["feature"] for p in out] == ["y1"]


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        information.greedy_select(packed(spark, [A], Y), ["a"], "NOPE", 1)


def test_bootstrap_draws_as_many_rows_as_there_are(spark):
    w = stability.bootstrap_weights(spark.range(200), "id", 3, 1)
    assert {r["run"]: r["n"] for r in w.groupBy("run").agg(F.sum("w").alias("n")).collect()} == {0: 200, 1: 200, 2: 200}
    p = stability.bootstrap_weights(spark.range(5000), "id", 1, 1, approx=True).agg(F.sum("w")).first()[0]
    assert 4700 < p < 5300
    assert stability.bootstrap_weights(spark.range(5), "id", 0).agg(F.sum("w")).first()[0] == 5


def test_weights_equal_repeated_rows(spark):
    base = spark.createDataFrame([(i, float(i % 7), float(i % 5), i % 2) for i in range(60)], "row_id bigint, a double, b double, y int")
    w = stability.bootstrap_weights(base, "row_id", 2, 4)
    target = base.select("row_id", "y")
    p = stability.packed_bootstraps(base, ["a", "b"], w, 2, target, 4)
    got = {(q["run"], q["feature"]): q["mi"] for q in information.greedy_select(p, ["a", "b"], "MIM", 2, run_col="run")}
    for run in (0, 1):
        copies = w.filter(F.col("run") == run).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("w").cast("int")))).join(base, "row_id")
        long = copies.select("row_id", "copy", "y", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in "ab"])).alias("s")).select("row_id", "copy", "y", "s.*")
        binned = preprocess.apply_bins(long, preprocess.fit_bins(long, 4))
        j = binned.groupBy("feature", F.col("bin").alias("x"), "y").agg(F.count("*").alias("c"))
        for r in information.mutual_information(j).collect():
            assert abs(got[run, r["feature"]] - r["mi"]) < 1e-9


def test_stability_rule(spark):
    sel = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a"), (1, "c"), (2, "a"), (2, "b")], "run int, feature string")
    assert [(r["feature"], r["times"]) for r in stability.stability_select(sel, 2, 5).orderBy("rank").collect()] == [("a", 3), ("b", 2)]


def test_spearman_with_ties(spark):
    xs, ys = [1, 2, 2, 3, 4, 4, 4, 5], [2, 1, 3, 3, 5, 4, 4, 6]
    rows = [("f", x, y) for x, y in zip(xs, ys)] + [("k", 1, y) for y in ys]
    j = spark.createDataFrame(rows, "feature string, x int, y int").groupBy("feature", "x", "y").agg(F.count("*").alias("c"))
    got = {r["feature"]: r["rho"] for r in information.spearman(j).collect()}
    rank = lambda v: [sum(a < b for a in v) + (sum(a == b for a in v) + 1) / 2 for b in v]
    rx, ry, n = rank(xs), rank(ys), len(xs)
    m = (n + 1) / 2
    exp = sum((a - m) * (b - m) for a, b in zip(rx, ry)) / (sum((a - m) ** 2 for a in rx) * sum((b - m) ** 2 for b in ry)) ** 0.5
    assert abs(got["f"] - exp) < 1e-12 and got["k"] is None


def test_screen_narrows_each_bootstrap(spark):
    base = spark.createDataFrame([(i, float(i % 7), float(i % 5), 1.0, i % 2) for i in range(60)], "row_id bigint, a double, b double, c double, y int")
    seen = []

    def screen(rows):
        seen.append(rows.count())
        return ["a"] if len(seen) == 1 else ["b", "c"]

    for method in ("MIM", "JMI", "CORR", "FCBF"):
        seen.clear()
        picks = stability.supervised_screen(base, ["a", "b", "c"], base.select("row_id", "y"), method, 2, 4, 2, seed=4, screen=screen)
        assert seen == [60, 60]
        assert {p["feature"] for p in picks if p["run"] == 0} <= {"a"} and {p["feature"] for p in picks if p["run"] == 1} <= {"b", "c"}


def test_bins_keep_to_their_feature_where_another_has_no_edges(spark):
    base = spark.createDataFrame([(i, None, float(i), float(-i)) for i in range(8)], "row_id int, a double, b double, c double")
    feats = ["a", "b", "c"]
    edges = preprocess.fit_bins(schema.melt(base, feats, ["row_id"]), 4)
    packed = information.pack_bins(schema.as_vector(base, feats, ["row_id"]), edges, feats, n_bins=4)
    got = {r["row_id"]: list(r["bins"]) for r in packed.collect()}
    assert got == {i: [None, i // 2, 3 - i // 2] for i in range(8)}


def test_bins_by_run_with_missing_values(spark):
    edges = spark.createDataFrame([(1, "a", [0.0, 2.0]), (2, "a", [1.0]), (2, "b", [5.0])], "run int, feature string, edges array<double>")
    nan = float("nan")
    rows = [(1, [v, v]) for v in (-1.0, -0.0, 2.0, None, nan)] + [(2, [v, v]) for v in (0.5, 5.0)] + [(3, [1.0, 1.0]), (None, [1.0, 1.0])]
    vec = spark.createDataFrame(rows, "run int, x array<double>")
    got = [(r["run"], r["bins"]) for r in information.pack_bins(vec, edges, ["a", "b"], ["run"], 2, 3).collect()]
    want = [(1, [0, 0]), (1, [1, 0]), (1, [2, 0]), (1, [None, None]), (1, [2, 0]), (2, [0, 0]), (2, [1, 1])]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_bootstrap_weights_are_made_once(spark, monkeypatch):
    base = spark.createDataFrame([(i, float(i), float(i % 5), i % 2) for i in range(40)], "row_id int, a double, b double, y int")
    seen = spark.sparkContext.accumulator(0)

    def counted(df, id_col, n_runs, seed=0):
        def touch(frames):
            for f in frames:
                seen.add(len(f))
                yield f.assign(run=0, w=1)[["run", "row_id", "w"]]

        return df.select("row_id").mapInPandas(touch, "run int, row_id int, w long")

    monkeypatch.setattr(stability, "bootstrap_weights", counted)
    picks = stability.supervised_screen(base, ["a", "b"], base.select("row_id", "y"), "MIM", 1, 4, 1)
    assert len(picks) == 1 and seen.value == 40
