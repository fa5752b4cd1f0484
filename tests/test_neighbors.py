import numpy as np
import pytest

from hazardlake.operators import neighbors


@pytest.mark.parametrize("dim", [1, 2, 3])
def test_tiles_match_brute_force(spark, dim):
    rng = np.random.default_rng(dim)
    v = rng.normal(size=(260, dim))
    v[:90, 0] = 1.5  # a third of the points share their first coordinate
    g = ["x" if i % 4 else "y" for i in range(len(v))]
    pts = spark.createDataFrame([(g[i], i, [float(a) for a in v[i]]) for i in range(len(v))], "g string, id bigint, v array<double>")
    pts = neighbors.jittered(pts).cache()
    at = {r["id"]: np.array(r["v"]) for r in pts.collect()}
    tiles = neighbors.Tiles(pts, 16)
    near = tiles.kth_distance(pts, 4)
    got = {r["id"]: r["r"] for r in near.collect()}
    radii = near.cache()
    counts = {r["id"]: r["n"] for r in tiles.count_within(radii).collect()}
    for i in range(len(v)):
        d = sorted(np.abs(at[i] - at[j]).max() for j in range(len(v)) if g[j] == g[i])
        assert got[i] == d[3] and counts[i] == 4


def test_whole_number_digamma(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 5, 19, 20, 21, 1000)], "n int")
    for r in df.select("n", neighbors.digamma_int(df["n"]).alias("p")).collect():
        exact = -0.5772156649015329 + sum(1.0 / i for i in range(1, r["n"]))
        assert abs(r["p"] - exact) < 1e-10


def test_more_tiles_than_a_thousand(spark):
    """One axis, 20,000 points in tiles of 8; a ball that spans most of them is counted from sums."""
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=20_000), 3)
    pts = spark.createDataFrame([("x", i, [float(a)]) for i, a in enumerate(v)], "g string, id bigint, v array<double>").repartition(8).cache()
    tiles = neighbors.Tiles(pts, 8)
    assert tiles.points.select("tile").distinct().count() > 1024
    asked = pts.filter("id % 50 = 0").withColumn("r", (pts["id"] % 7) * 0.25)
    got = {r["id"]: r["n"] for r in tiles.count_within(asked).collect()}
    assert got == {i: int((np.abs(v - v[i]) <= (i % 7) * 0.25).sum()) for i in range(0, 20_000, 50)}


@pytest.mark.parametrize("dim", [1, 2, 3])
def test_slabs_hold_all_that_is_near(dim, monkeypatch):
    rnd = np.random.default_rng(dim)
    b = np.concatenate([rnd.normal(size=(700, dim)), np.zeros((30, dim)), [[50.0] * dim]])
    a = np.concatenate([b[::3], rnd.normal(size=(90, dim)) * 4])
    d = np.abs(a[:, None] - b[None]).max(axis=2)
    compared, plain = [], neighbors._distances
    monkeypatch.setattr(neighbors, "_distances", lambda x, y: (compared.append(len(x) * len(y)), plain(x, y))[1])
    assert np.array_equal(neighbors.nearest_distances(a, b, 5), np.sort(d, axis=1)[:, :5])
    assert np.array_equal(neighbors.nearest_distances(a, b[:3], 5), np.sort(d[:, :3], axis=1))
    r = np.sort(d, axis=1)[:, 4]
    compared.clear()
    assert np.array_equal(neighbors.counts_within(a, r, b), (d <= r[:, None]).sum(axis=1))
    assert sum(compared) < d.size  # not every pair


def test_slabs_with_missing_values():
    rnd = np.random.default_rng(9)
    b = rnd.normal(size=(400, 2))
    b[::9, 0], b[::11, 1] = np.nan, np.nan
    a = b[::2]
    d = np.abs(a[:, None] - b[None]).max(axis=2)
    assert np.array_equal(neighbors.nearest_distances(a, b, 4), np.sort(d, axis=1)[:, :4], equal_nan=True)
    few = b[[0, 9, 1]]  # fewer whole points than asked for
    assert np.array_equal(neighbors.nearest_distances(a, few, 3), np.sort(np.abs(a[:, None] - few[None]).max(axis=2), axis=1), equal_nan=True)
    r = np.sort(d, axis=1)[:, 3]
    assert np.array_equal(neighbors.counts_within(a, r, b), (d <= r[:, None]).sum(axis=1))
