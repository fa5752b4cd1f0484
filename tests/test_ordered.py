import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazardlake.functions.ordered import average_ranks, exact_quantiles, hash_rank, running_totals


@pytest.mark.parametrize("sample_every", [1, 3, 1024])
@pytest.mark.parametrize("keys", [["g"], []])
def test_running_totals_in_ranges(spark, sample_every, keys):
    rng = np.random.default_rng(3)
    vals = np.unique(rng.normal(size=5000))
    rows = [("hot" if i % 3 else "cold", float(v), int(rng.integers(0, 5))) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "g string, v double, c bigint")
    got = running_totals(df, keys, "v", ["c"], sample_every).toPandas().sort_values("v")
    exp = pd.DataFrame(rows, columns=["g", "v", "c"]).sort_values("v")
    by = exp.groupby("g") if keys else exp.assign(one=1).groupby("one")
    assert (got["c_upto"].to_numpy() == by["c"].cumsum().to_numpy()).all()
    assert (got["c_all"].to_numpy() == by["c"].transform("sum").to_numpy()).all()


def test_running_totals_orders_text(spark):
    words = sorted({"w%04d" % random.Random(i).randint(0, 9999) for i in range(400)})
    df = spark.createDataFrame([(w, 1) for w in words], "v string, c bigint")
    got = running_totals(df, [], "v", ["c"], 1).orderBy("v").collect()
    assert [r["c_upto"] for r in got] == list(range(1, len(words) + 1))


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    data = {"hot": np.where(rng.random(900) < 0.4, 7.0, rng.normal(size=900) * 10), "one": np.array([3.5]), "two": np.array([1.0, 2.0])}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs] + [("hot", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r["quantiles"] for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    for g, vs in data.items():
        assert np.allclose(got[g], np.quantile(vs, probs))


def test_weighted_quantiles_equal_repeated_rows(spark):
    rows = [(float(v), w) for v, w in [(1, 3), (2, 1), (5, 4), (9, 2)]]
    df = spark.createDataFrame(rows, "v double, w bigint")
    got = exact_quantiles(df, [], "v", [0.25, 0.5, 0.8], "w").first()["quantiles"]
    assert np.allclose(got, np.quantile(np.repeat([1, 2, 5, 9], [3, 1, 4, 2]), [0.25, 0.5, 0.8]))


def test_hash_rank_is_md5_order(spark):
    df = spark.createDataFrame([(i,) for i in range(500)], "id bigint")
    for digits in (1, 4):
        got = {r["id"]: r["rank"] for r in hash_rank(df, "id", 9, digits=digits).collect()}
        order = sorted(range(500), key=lambda i: hashlib.md5(f"9:{i}".encode()).hexdigest())
        assert [got[i] for i in order] == list(range(1, 501))


def test_result_does_not_depend_on_partitions(spark):
    df = spark.range(2000).select(F.col("id"), F.pmod(F.hash("id"), F.lit(50)).cast("double").alias("v"))
    counts = df.groupBy("v").agg(F.count("*").alias("c"))
    one = sorted(map(tuple, average_ranks(counts.coalesce(1), [], "v", "c").collect()))
    many = sorted(map(tuple, average_ranks(counts.repartition(13), [], "v", "c").collect()))
    assert one == many
