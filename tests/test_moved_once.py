"""Large sides stay in place or move once."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from hazardlake.functions.ordered import exact_quantiles, hash_rank, running_totals
from hazardlake.operators import ensemble, unsupervised
from hazardlake.sources import sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_guess(spark):
    """Only joins that ask for it send a side to every task."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def test_ranks_without_a_join(spark, no_guess):
    rows = [(k, i) for k in ("a", None) for i in [*range(200), None]]
    got = hash_rank(spark.createDataFrame(rows, "k string, id int"), "id", 4, ["k"], total_col="n")
    assert "Join" not in plan(got)
    for key in ("a", None):
        mine = got.filter(F.col("k").eqNullSafe(F.lit(key))).collect()
        assert sorted(r["rank"] for r in mine) == list(range(1, 202)) and {r["n"] for r in mine} == {201}
        order = spark.createDataFrame([(i,) for i in range(200)], "id int").orderBy(F.md5(F.concat(F.lit("4:"), F.col("id").cast("string"))), "id")
        assert [r["id"] for r in order.collect()] == [r["id"] for r in sorted(mine, key=lambda r: r["rank"]) if r["id"] is not None]


def test_totals_move_rows_without_a_sorted_join(spark, no_guess):
    rows = [(k, float(v), v % 5) for k in ("a", None) for v in range(300)]
    got = running_totals(spark.createDataFrame(rows, "k string, v double, c long"), ["k"], "v", ["c"], sample_every=4)
    assert plan(got).count("SortMergeJoin") < 3  # that of the boundaries, for the rows and for their sums
    assert all(r["c_upto"] == sum(i % 5 for i in range(int(r["v"]) + 1)) and r["c_all"] == 600 for r in got.collect())


def test_quantiles_order_only_ranges_with_a_wanted_position(spark, no_guess):
    import numpy as np

    rnd = random.Random(3)
    values = [round(rnd.gauss(0, 5), 1) for _ in range(5000)]
    probs = [0.9, 0.1, 0.5, 0.1, *[i / 2000 for i in range(2001)]]
    df = spark.createDataFrame([(k, v) for k in ("a", None) for v in values], "k string, v double")
    got = exact_quantiles(df, ["k"], "v", probs)
    assert "SortMergeJoin" not in plan(got)
    for r in got.collect():
        assert np.allclose(r["quantiles"], np.quantile(values, probs), rtol=0, atol=1e-9)


def test_groups_and_cells_are_sent_to_the_rows(spark, no_guess):
    long = spark.createDataFrame([(i, f, float(i)) for i in range(20) for f in "abc"], "row_id int, feature string, value double")
    groups = spark.createDataFrame([("group_a", "a"), ("group_a", "b")], "group string, member string")
    out = unsupervised.apply_groups(long, groups, ["row_id"])
    assert "SortMergeJoin" not in plan(out) and out.count() == 40
    pred = spark.createDataFrame([(r, "test", m, "x", float(i)) for r in (1, None) for m in "ab" for i in range(3)], "run int, split string, model string, modality string, risk double")
    scaled = ensemble.normalize_predictions(pred)
    assert "SortMergeJoin" not in plan(scaled) and sorted(r["p"] for r in scaled.collect()) == [0.0] * 4 + [0.5] * 4 + [1.0] * 4


def test_predictions_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    seen, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (seen.append(spark.conf.get(sinks._WRITERS, "0")), write(self, *a, **k))[1])
    pred = spark.createDataFrame([(r, s, i) for r in (1, 2) for s in ("train", "test") for i in range(5)], "run int, split string, row_id int")
    sinks.write_predictions(pred, str(tmp_path / "p"))
    assert int(seen[0]) >= 4 and spark.conf.get(sinks._WRITERS, "0") in ("0", None)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 20
