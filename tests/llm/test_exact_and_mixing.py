import hashlib
import re

import pytest
from samples import ODD, table

from hazardlake.llm import exact, mixing
from hazardlake.llm.common import stage

SPACE = r"[\x20\x09-\x0D]+"


def clean(t):
    return re.sub(SPACE, " ", t or "")


def test_exact_dedup_of_odd_rows(spark):
    got = exact.exact_dedup(table(spark)).collect()
    assert len(got) == len(ODD)
    groups = {}
    for i, t in ODD:
        groups.setdefault(clean(t), []).append(i)
    for ids in groups.values():
        ids.sort(key=lambda x: (x is None, x))
    want = sorted((i or -1, groups[clean(t)][0], len(groups[clean(t)]), hashlib.sha256(clean(t).encode()).hexdigest()) for i, t in ODD)
    assert sorted((r.doc_id or -1, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    # one row of each group stays
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_rounds_merge_all_runs(spark):
    rows = [(i, f"text {i % 5}") for i in range(200)]
    got = exact.exact_dedup(table(spark, rows), fan_in=2).collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(k, 40) for k in range(5)}


def test_keep_first_returns_whole_rows(spark):
    docs = table(spark)
    kept = exact.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(clean(r.text) for r in kept.collect()) == sorted({clean(t) for _, t in ODD})


def test_empty_tables(spark):
    docs = table(spark).limit(0)
    assert exact.exact_dedup(docs).count() == 0
    assert exact.keep_first(docs).count() == 0
    mix = mixing.mix_sources(docs)
    assert mixing.taken(mix).count() == 0 and mix.draws.count() == 0


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def wanted_targets(sizes, weights, ratio, most):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    budget, full = ratio * sum(sizes.values()), set()
    while True:
        left = budget - sum(most * sizes[s] for s in full)
        total = sum(w[s] for s in sizes if s not in full)
        new = {s for s in sizes if s not in full and w[s] * left / total > most * sizes[s]}
        if not new:
            return {s: most * sizes[s] if s in full else w[s] * left / total for s in sizes}
        full |= new


@pytest.mark.parametrize("block,shard", [(256, 65536), (16, 100)])
def test_mixture_of_odd_rows(spark, block, shard):
    docs = table(spark)
    mix = mixing.mix_sources(docs, block_words=block, shard_draws=shard)
    rows = mixing.taken(mix).collect()
    assert len(rows) == len(ODD)
    assert sorted(r.size for r in rows) == sorted(size(t) for _, t in ODD)
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    want = wanted_targets(sizes, (3, 1, 2), 1.5, 2)
    got = {}
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken <= 2 * r["size"]
        got[r.source] = got.get(r.source, 0) + r.taken
    for s in want:
        assert abs(got[s] - want[s]) <= 1


def test_shards_are_even_disjoint_and_repeatable(spark):
    rows = [(i, " ".join(["w"] * (40 + i % 7))) for i in range(300)]
    sources = [("a" if i % 3 else f"s{i % 10}") for i in range(300)]
    draws = stage(mixing.mix_sources(table(spark, rows, sources=sources), block_words=8, shard_draws=128).draws, "test-draws")
    again = mixing.mix_sources(table(spark, rows, sources=sources).repartition(7), block_words=8, shard_draws=128).draws
    assert draws.exceptAll(again).isEmpty() and again.exceptAll(draws).isEmpty()
    got = draws.collect()
    per = {}
    for r in got:
        per.setdefault(r.shard, []).append(r)
    counts = [len(v) for v in per.values()]
    assert len(per) > 8 and max(counts) - min(counts) <= 1
    assert len({(r.doc_id, r._row, r.epoch, r.start_word) for r in got}) == len(got)
    for v in per.values():
        assert sorted(r.position for r in v) == list(range(1, len(v) + 1))
    # a hypergeometric share of the hot source in every shard, not all of it in one
    hot = [sum(r.source == "a" for r in v) for v in per.values()]
    mean = sum(hot) / len(hot)
    assert all(0.5 * mean < x < 1.5 * mean for x in hot) and len(set(hot)) > 1


def test_hypergeometric_keeps_mean_and_spread(spark):
    from pyspark.sql import functions as F

    for n, k, m in ((100, 40, 30), (10_000, 4_000, 3_000)):
        c = lambda v: F.lit(v).cast("bigint")
        row = spark.range(4000).select(mixing.hypergeometric(c(n), c(k), c(m), "t", F.col("id")).alias("x")).agg(F.avg("x"), F.var_samp("x"), F.min("x"), F.max("x")).first()
        var = m * k / n * (1 - k / n) * (n - m) / (n - 1)
        assert abs(row[0] - m * k / n) < 5 * (var / 4000) ** 0.5
        assert 0.85 < row[1] / var < 1.15
        assert row[2] >= 0 and row[3] <= min(k, m)


def test_hypergeometric_counts_follow_their_probabilities(spark):
    from math import comb

    from pyspark.sql import functions as F

    c = lambda v: F.lit(v).cast("bigint")
    for n, k, m in ((12, 5, 6), (40, 33, 30), (7, 7, 3), (9, 0, 4)):
        got = dict(spark.range(20000).select(mixing.hypergeometric(c(n), c(k), c(m), "p", F.col("id")).alias("x")).groupBy("x").count().collect())
        want = {i: comb(k, i) * comb(n - k, m - i) / comb(n, m) for i in range(max(0, m - n + k), min(k, m) + 1)}
        assert set(got) <= set(want)
        for i, p in want.items():
            assert abs(got.get(i, 0) - 20000 * p) <= 5 * (20000 * p * (1 - p)) ** 0.5 + 1e-9
    # an urn of a billion draws goes the same way
    n, k, m = 10**9, 3 * 10**8, 5 * 10**8
    row = spark.range(40).repartition(8).select(mixing.hypergeometric(c(n), c(k), c(m), "q", F.col("id")).alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    spread = (m * k / n * (1 - k / n) * (n - m) / (n - 1)) ** 0.5
    assert abs(row[0] - m * k / n) < 5 * spread / 40**0.5 and 0.5 < row[1] / spread < 1.5


def test_words_taken_come_with_their_places(spark):
    import hashlib

    rows = [(i if i % 5 else None, " ".join(["w"] * (20 + i % 9))) for i in range(120)]
    mix = mixing.mix_sources(table(spark, rows, sources=[f"s{i % 3}" for i in range(120)]), block_words=8, shard_draws=32)
    places = {}
    for d in mix.draws.collect():
        places.setdefault((d.doc_id, d._row), []).append((d.shard, d.position, d.n_words))
    found = mixing.taken(mix).collect()
    assert len({(r.doc_id, r._row) for r in found}) == 120
    for r in found:
        mine = places.get((r.doc_id, r._row), [])
        assert r.taken == sum(x[2] for x in mine) and r.n_draws == len(mine) and r.n_shards == len({x[0] for x in mine})
        text = ",".join(sorted(f"{a}:{b}" for a, b, _ in mine))
        assert r.places_sha256 == (hashlib.sha256(text.encode()).hexdigest() if mine else None)
