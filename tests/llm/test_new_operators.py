import itertools
import math
import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hazardlake.llm import license, resampling, spelling
from samples import LONG, ODD, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(UP))


# license scans

NOTICE = dict(license.TEMPLATES)


def scattered(label, seed):
    """The notice with upper case, line breaks and its words in another order."""
    w = NOTICE[label].split()
    random.Random(seed).shuffle(w)
    return ",\n".join(x.title() for x in w)


LICENSED = ODD + [
    (20, "Released under the MIT License. MIT license"),
    (21, "the\nGNU General  Public-License, and the apache license"),
    (22, "mit licenses, mitlicense, license mit, general license"),
    (23, " ".join(f"w{i}" for i in range(50)) + " " + scattered("bsd", 1) + " " + " ".join(f"v{i}" for i in range(90))),
    (24, scattered("gpl", 2) + " x " * 200 + scattered("mpl", 3)),
    (25, NOTICE["mit"].replace("permission", "x")),
    (26, NOTICE["mit"].replace("permission is hereby", "x y z")),
    (27, "Licensed under CC BY-NC 4.0."),
    (28, "Licensed under CC BY-SA 4.0."),
    (29, LONG + " " + NOTICE["bsd"]),
    (29, LONG + " " + NOTICE["bsd"]),
    (None, NOTICE["apache"]),
]


def licenses_by_hand(text, templates=license.TEMPLATES, block=license.BLOCK, threshold=license.THRESHOLD):
    w = words_of(text)
    base = []
    for phrase, label in license.PHRASES:
        p = phrase.split()
        base += [(label, i) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    half, met = block // 2, []
    for start in range(0, max(0, math.ceil((len(w) - block) / half)) * half + 1, half):
        inside = set(w[start : start + block])
        for label, t in templates:
            t = set(words_of(t))
            if t and w and len(t & inside) >= max(1, math.ceil(threshold * len(t) - 1e-9)):
                met.append((label, start, len(t & inside) / len(t)))
    at = [i for _, i in base]
    names = lambda x: ",".join(sorted(set(x)))
    score = 1.0 if base else max([c for *_, c in met], default=0.0)
    return (
        len(w), len(base), min(at, default=None), max(at, default=None), names(x for x, _ in base),
        names([x for x, _ in base] + [x for x, *_ in met]), score, len({s for _, s, _ in met}),
    )


def test_licenses_equal_brute_force(spark):
    found = license.license_labels(table(spark, LICENSED))
    want = Counter((i, *licenses_by_hand(t)) for i, t in LICENSED)
    assert Counter(tuple(r) for r in found.collect()) == want
    assert {r.labels for r in found.collect()} >= {"bsd", "gpl,mpl", "mit", "cc-by-nc", "apache,gpl", ""}


@pytest.mark.parametrize("seed", range(2))
def test_every_block_that_meets_a_template_is_found(spark, seed):
    rng = random.Random(seed)
    made = lambda n: " ".join(f"t{min(rng.randrange(60), rng.randrange(60))}" for _ in range(n))
    templates = [(f"l{i % 7}", made(rng.randrange(1, 25))) for i in range(20)] + [("none", ""), (None, "t1 t2 t3")]
    docs = [(i, made(rng.randrange(0, 400))) for i in range(40)]
    _, blocks = license.scan(table(spark, docs), templates, threshold=0.7, block=32)
    got = {(r.doc, r.label, r.start, round(r.containment, 9)) for r in blocks.collect()}
    want = set()
    for i, text in docs:
        w = words_of(text)
        for start in range(0, max(0, math.ceil((len(w) - 32) / 16)) * 16 + 1, 16):
            for label, t in templates:
                t, inside = set(t.split()), set(w[start : start + 32])
                if t and len(t & inside) >= math.ceil(0.7 * len(t) - 1e-9):
                    want.add((i, label, start, round(len(t & inside) / len(t), 9)))
    assert got == want and len(want) > 100


def test_licenses_without_rows_templates_or_phrases(spark):
    assert license.license_labels(table(spark, []).filter("false")).isEmpty()
    docs = table(spark, [(1, "the mit license"), (2, None)])
    only = {r.doc_id: r.labels for r in license.license_labels(docs, templates=[]).collect()}
    assert only == {1: "mit", 2: ""}
    bare = license.license_labels(docs, phrases=[], templates=[("x", "the license mit")]).orderBy("doc_id").collect()
    assert [(r.labels, r.n_base, r.score) for r in bare] == [("x", 0, 1.0), ("", 0, 0.0)]


# resampling


def features(text):
    w = words_of(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def test_feature_buckets_equal_brute_force():
    rng = random.Random(3)
    texts = [None, "", "One", "a b", "a b a b", "Ünï ÀB z", "x" * 5000] + [" ".join(rng.choice("abcde") * rng.randrange(1, 4) for _ in range(50)) for _ in range(20)]
    buckets, owner, n_words = resampling.feature_buckets(pa.array(texts, pa.string()), 97)
    got = [Counter(buckets[owner == i].tolist()) for i in range(len(texts))]
    assert got == [Counter(crc32(f.encode()) % 97 for f in features(t)) for t in texts]
    assert n_words.tolist() == [len(words_of(t)) for t in texts]


def test_pieces_of_a_column_are_whole(monkeypatch):
    monkeypatch.setattr(resampling, "PIECE", 3000)
    texts = [t for _, t in ODD] * 3
    column = pa.array(texts, pa.string())
    got = []
    for a, piece in resampling.cut(column):
        buckets, owner, _ = resampling.feature_buckets(piece, 97)
        got += [Counter(buckets[owner == i].tolist()) for i in range(len(piece))]
    assert got == [Counter(crc32(f.encode()) % 97 for f in features(t)) for t in texts]


def resampled_by_hand(docs, target, percent=25, n=10_000):
    count = lambda texts: Counter(crc32(f.encode()) % n for t in texts for f in features(t))
    s, t = count(x for _, x in docs), count(target)
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + n) / ((s[b] + 1) * (T + n))))
    rows = []
    for i, text in docs:
        f = features(text)
        weight = sum(gain(crc32(x.encode()) % n) for x in f) // len(f) if f else 0
        h = int(sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(f), weight, score, len(words_of(text)) >= 20])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return Counter((*r[:4], drawn.get(id(r))) for r in rows)


@pytest.mark.parametrize("percent", [25, 100])
def test_resampling_equals_brute_force(spark, percent):
    rng = random.Random(4)
    docs = ODD + [(100 + i, " ".join(f"w{rng.randrange(200)}" for _ in range(rng.randrange(10, 60)))) for i in range(60)]
    docs += [(100, docs[-60][1]), (100, docs[-60][1])]
    target = ["w1 w2 w3", None, "", "w5 w6 w5 w6"]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id long, text string, h string")
    found = resampling.resample(table(spark, docs), bench, percent=percent)
    assert Counter(tuple(r) for r in found.collect()) == resampled_by_hand(docs, target, percent)


def test_resampling_of_empty_tables(spark):
    docs = table(spark, [(i, " ".join(f"v{k}" for k in range(i, i + 25))) for i in range(8)])
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(docs.filter("false"), none).isEmpty()
    assert sorted(r.rank for r in resampling.resample(docs, none).collect() if r.rank) == [1, 2]


# spelling variants


def edits(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b))
    if len(a) > len(b):
        a, b = b, a
    return 1 if len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b))) else 2


def spelled_by_hand(docs):
    seen = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UP)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += len(run) >= 7
    n = {w: c for w, c in seen.items() if c >= 2}
    near = {w: [v for v in n if v != w and abs(len(v) - len(w)) < 2 and edits(v, w) == 1] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v.encode()), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def test_spelling_equals_brute_force(spark):
    rng = random.Random(5)
    stems = ["international", "Répertoire", "banana", "misspell", "aaaaaaaa"]
    docs = list(ODD)
    for i in range(300):
        made = []
        for _ in range(20):
            w = rng.choice(stems[: 1 + rng.randrange(5)])
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", w[k] + rng.choice("abé"), rng.choice("abÉ")]) + w[k + 1 :]
            made.append(w)
        docs.append((i, rng.choice([" ", "\n", "-"]).join(made)))
    found = spelling.spelling_variants(table(spark, docs))
    got = [tuple(r) for r in found.collect()]
    want = spelled_by_hand(docs)
    assert set(got) == want and len(got) == len(want)
    assert any(f and f != r for _, f, r, *_ in want)  # a chain of two forms


@pytest.mark.parametrize("tile", [2, 5, 256])
def test_near_pairs_of_large_groups(spark, tile):
    """Few letters: groups are cut again and again, down to one code point."""
    rng = random.Random(tile)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(7, 11))) for _ in range(250)}
    words |= {"a" * n for n in (7, 8, 9, 30, 31)} | {"a" * 12 + c + "b" * 12 for c in "abcdeéß"} | {"x" * 3000, "x" * 2999, "x" * 1500 + "y" + "x" * 1500}
    vocabulary = spark.createDataFrame([(w,) for w in words], "word string")
    got = [tuple(r) for r in spelling.near_pairs(spelling.groups(vocabulary, tile)).collect()]
    want = {(a, b) for a, b in itertools.permutations(words, 2) if abs(len(a) - len(b)) < 2 and edits(a, b) == 1}
    assert set(got) == want and len(got) == len(want)


def test_spelling_of_empty_tables(spark):
    assert spelling.spelling_variants(table(spark, []).filter("false")).isEmpty()
    assert spelling.spelling_variants(table(spark, [(1, None), (2, "short only")])).isEmpty()


def test_sizes_of_groups_stay_under_the_tile(spark):
    words = {f"prefix{a}{b}{c}suffix" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"}
    vocabulary = spark.createDataFrame([(w,) for w in words], "word string")
    sizes = spelling.groups(vocabulary, 64).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    assert sizes.agg(F.max("n")).first()[0] <= 64
    assert np.isclose(spelling.near_pairs(spelling.groups(vocabulary, 64)).count(), 512 * 21)
