"""Thousands of columns: correlation by blocks and one Cox model per column."""

import resource

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hazardlake.operators import coxscreen, unsupervised
from hazardlake.session import materialize


def matrix(n, p, seed, gaps=0.1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) + rng.normal(size=(n, 1)) * rng.uniform(0, 2, p)
    x[rng.uniform(size=x.shape) < gaps] = np.nan
    x[:, p // 2] = 3.0
    x[:, p // 3] = np.nan
    return x


def vectors(spark, x):
    rows = [([None if np.isnan(v) else float(v) for v in r],) for r in x]
    return spark.createDataFrame(rows, "x array<double>").repartition(3)


@pytest.mark.parametrize("block", [1, 4, 5, 64])
def test_blocks_of_pairs_equal_pandas(spark, block):
    x = matrix(60, 13, 1)
    names = [f"f{i}" for i in range(13)]
    want = pd.DataFrame(x, columns=names).corr(min_periods=2)
    seen = ~np.isnan(x)
    got = unsupervised.pearson_pairs(vectors(spark, x), names, block=block).collect()
    assert sorted((r.i, r.j) for r in got) == [(i, j) for i in range(13) for j in range(i)]
    for r in got:
        w = want.loc[r.f1, r.f2]
        assert (r.f1, r.f2) == (names[r.j], names[r.i]) and r.n == (seen[:, r.i] & seen[:, r.j]).sum()
        assert r.r is None if np.isnan(w) else abs(r.r - w) < 1e-10
    edges = unsupervised.pearson_pairs(vectors(spark, x), names[2:], threshold=0.5, index=range(2, 13), block=block)
    assert {(r.f1, r.f2) for r in edges.collect()} == {(r.f1, r.f2) for r in got if r.j >= 2 and r.r is not None and r.r >= 0.5}


def test_five_thousand_columns_fit_a_small_worker(spark):
    """Four 5,000 x 5,000 products are 800 MB; blocks stay far below."""
    n, p = 300, 5000
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, p))
    copies = [(4999, 3), (2500, 1023), (1024, 1023), (4000, 2500)]
    for i, j in copies:
        x[:, i] = x[:, j] + 0.05 * rng.normal(size=n)
    frame = materialize(spark.createDataFrame(pa.table({"x": list(x)})).repartition(4))
    edges = materialize(unsupervised.pearson_pairs(frame, [f"f{i}" for i in range(p)], threshold=0.8))
    # 4000 follows 2500, which follows 1023, so all three pairs of them are edges
    assert {(r.i, r.j) for r in edges.collect()} == {*copies, (2500, 1024), (4000, 1023), (4000, 1024)}
    kept = unsupervised.drop_correlated(edges, p)
    assert {r.pos for r in kept.filter("NOT kept").collect()} == {4999, 2500, 1024, 4000}

    def peak(batches):
        for _ in batches:
            yield pd.DataFrame({"mb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024]})

    most = spark.range(64, numPartitions=8).mapInPandas(peak, "mb double").agg(F.max("mb")).first()[0]
    assert most < 700


def breslow(x, t, e):
    """Newton on one column by hand: (beta, likelihood-ratio statistic)."""
    ok = ~np.isnan(x)
    x, t, e = x[ok], t[ok], e[ok]

    def value(b):
        ll = g = h = 0.0
        for i in np.flatnonzero(e):
            risk = t >= t[i]
            top = (b * x[risk]).max()
            w = np.exp(b * x[risk] - top)
            m1, m2 = (x[risk] * w).sum() / w.sum(), (x[risk] ** 2 * w).sum() / w.sum()
            ll += b * x[i] - np.log(w.sum()) - top
            g += x[i] - m1
            h += m2 - m1 * m1
        return ll, g, h

    b, null = 0.0, value(0.0)[0]
    for _ in range(50):
        ll, g, h = value(b)
        if h < 1e-12 or abs(g) < 1e-10:
            break
        step = g / h
        while value(b + step)[0] < ll - 1e-12 and abs(step) > 1e-12:
            step /= 2
        b += step
    return b, 2 * (value(b)[0] - null)


@pytest.mark.parametrize("block, least, hot", [(64, 1 << 16, False), (3, 10, False), (4, 16, True), (1, 5, True)])
def test_univariate_models_equal_newton_by_hand(spark, block, least, hot):
    rng = np.random.default_rng(block)
    n, p = 150, 9
    x = matrix(n, p, 5)
    x[:, 1] = np.exp(3 * rng.normal(size=n))  # heavy tail
    t = np.ceil(rng.exponential(np.exp(-0.7 * np.nan_to_num(x[:, 0]))) * 20)
    if hot:
        t[rng.uniform(size=n) < 0.4] = 7.0  # one time with a large share of the rows
    e = (rng.uniform(size=n) < 0.7).astype(int)
    rows = [(int(e[i]), float(t[i]), [None if np.isnan(v) else float(v) for v in x[i]]) for i in range(n)] + [(None, 1.0, [0.0] * p), (1, None, [0.0] * p)]
    frame = spark.createDataFrame(rows, "os int, os_time double, x array<double>").repartition(5)
    got = {r.feature: r for r in coxscreen.univariate_screen(frame, [f"f{i}" for i in range(p)], block=block, least_rows=least).collect()}
    for i in range(p):
        b, lr = breslow(x[:, i], t, e) if not np.isnan(x[:, i]).all() else (0.0, 0.0)
        assert abs(got[f"f{i}"].lr - lr) < 1e-5 * (1 + lr), i
        assert abs(got[f"f{i}"].beta - b) < 1e-4 * (1 + abs(b)), i
    assert sorted(r.rank for r in got.values()) == list(range(1, p + 1))


def test_large_linear_predictors_are_not_clipped(spark):
    x = np.array([0.0, 1.0, 2.0, 4000.0, 3.0, 1.5, 2.5, 0.5, 2.2, 3900.0])
    t = np.array([9.0, 5, 8, 1, 6, 3, 7, 2, 4, 10])
    frame = spark.createDataFrame([(1, float(a), [float(b)]) for a, b in zip(t, x)], "os int, os_time double, x array<double>")
    walk = coxscreen.Screen(frame, 1, 64, 1 << 16)
    beta = np.array([900.0])
    ll, g, h = walk.evaluate(beta, np.ones(1, bool))[:, 0]
    z = (x - x.mean()) / x.std()
    want = sum(900 * z[i] - np.logaddexp.reduce(900 * z[t >= t[i]]) for i in range(len(x)))
    assert np.isfinite([ll, g, h]).all() and abs(ll - want) < 1e-6 * abs(want)


def test_twenty_thousand_features(spark):
    n, p = 200, 20_000
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, p))
    t = rng.exponential(np.exp(-1.0 * x[:, 12_345]))
    frame = spark.createDataFrame(pa.table({"os": np.ones(n, int), "os_time": t, "x": list(x)})).repartition(4)
    out = coxscreen.univariate_screen(frame, [f"f{i}" for i in range(p)])
    assert out.count() == p and out.filter("rank = 1").first().feature == "f12345"


def test_no_features_and_no_rows(spark):
    empty = spark.createDataFrame([], "os int, os_time double, x array<double>")
    assert coxscreen.univariate_screen(empty, []).isEmpty()
    assert [r.lr for r in coxscreen.univariate_screen(empty, ["a", "b"]).collect()] == [0.0, 0.0]
