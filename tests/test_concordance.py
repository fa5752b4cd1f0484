import random

import numpy as np
import pytest

from hazardlake.operators.concordance import concordance_index, concordance_td, count_dominated


def brute(rows):
    conc = tied = comp = 0
    for _, e, t, r in rows:
        for _, e2, t2, r2 in rows:
            if e and (t2 > t or (t2 == t and not e2)):
                comp += 1
                conc += r > r2
                tied += r == r2
    return conc, tied, comp


def sample(n=240, seed=1):
    rnd = random.Random(seed)
    # a third of the rows share one time, another third one risk
    time = lambda: 8.0 if rnd.random() < 0.34 else float(rnd.randint(1, 60))
    risk = lambda: 3.0 if rnd.random() < 0.34 else rnd.random() * 6
    return [(rnd.choice("ab"), int(rnd.random() < 0.6), time(), risk()) for _ in range(n)]


@pytest.mark.parametrize("chunk", [1 << 17, 30, 5])
@pytest.mark.parametrize("keys", [["g"], []])
def test_matches_pair_counting(spark, chunk, keys):
    rows = sample()
    df = spark.createDataFrame(rows, "g string, e int, t double, r double")
    got = sorted(tuple(r)[: len(keys) + 3] for r in concordance_index(df, "e", "t", "r", keys, chunk).collect())
    exp = [(g, *brute([r for r in rows if r[0] == g])) for g in "ab"] if keys else [brute(rows)]
    assert got == exp


def test_all_censored_is_null(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, 2.0, 1.0), (0, 3.0, 0.0), (0, 3.0, 5.0)], "e int, t double, r double")
    r = concordance_index(df, "e", "t", "r").first()
    assert r["comparable"] == 0 and r["cindex"] is None


def test_tied_times_and_risks(spark):
    rows = [("x", 1, 5.0, 2.0), ("x", 0, 5.0, 1.0), ("x", 1, 5.0, 2.0), ("x", 1, 3.0, 2.0), ("x", 0, 3.0, 2.0), ("x", 0, 9.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, e int, t double, r double")
    assert tuple(concordance_index(df, "e", "t", "r").first())[:3] == brute(rows)


def test_reversed_risk_is_complement(spark):
    rnd = random.Random(4)
    rows = [(1, float(i), rnd.random()) for i in range(50)]
    df = spark.createDataFrame(rows, "e int, t double, r double")
    a = concordance_index(df, "e", "t", "r").first()["cindex"]
    b = concordance_index(df.withColumn("r", -df["r"]), "e", "t", "r").first()["cindex"]
    assert abs(a + b - 1) < 1e-12


def test_dominated_counts_directly():
    rng = np.random.default_rng(0)
    u, r, e, w = rng.integers(0, 9, 70), rng.integers(0, 7, 70), rng.integers(0, 2, 70), rng.integers(1, 4, 70)
    lt = sum(w[i] * w[j] for i in range(70) for j in range(70) if e[i] and u[i] < u[j] and r[j] < r[i])
    eq = sum(w[i] * w[j] for i in range(70) for j in range(70) if e[i] and u[i] < u[j] and r[j] == r[i])
    assert count_dominated(u, r, e, w) == (lt, eq)


def test_time_dependent_concordance(spark):
    rnd = random.Random(7)
    grid = [2.0, 4.0, 6.0]
    rows = [(int(rnd.random() < 0.7), float(rnd.randint(1, 8)), sorted((round(rnd.random(), 1) for _ in grid), reverse=True)) for _ in range(60)]
    df = spark.createDataFrame(rows, "e int, t double, curve array<double>")
    at = lambda t: next((i for i, g in enumerate(grid) if g >= t), len(grid) - 1)
    c = s = n = 0
    for e, t, cv in rows:
        for e2, t2, cv2 in rows:
            if e and (t2 > t or (t2 == t and not e2)):
                n += 1
                c += cv[at(t)] < cv2[at(t)]
                s += cv[at(t)] == cv2[at(t)]
    assert tuple(concordance_td(df, "e", "t", "curve", grid).first())[:3] == (c, s, n)


def test_input_is_read_once_whatever_the_ranges(spark):
    seen = spark.sparkContext.accumulator(0)

    def see(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(g, e, t, r if i % 7 else None) for i, (g, e, t, r) in enumerate(sample())]
    df = spark.createDataFrame(rows, "g string, e int, t double, r double").mapInArrow(see, "g string, e int, t double, r double")
    got = sorted(tuple(r)[:5] for r in concordance_index(df, "e", "t", "r", ["g"], 5).collect())
    known = lambda g: [r for r in rows if r[0] == g and r[3] is not None]
    assert got == [(g, *brute(known(g)), sum(r[0] == g and r[3] is None for r in rows)) for g in "ab"]
    assert seen.value == len(rows)
