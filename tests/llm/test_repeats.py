"""Suffix-array dedup, near-duplicates and fuzzy passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from samples import LONG, ODD, PASSAGE, changed, table, words

from hazardlake.llm import chaining, neardup, shingles, suffix


def brute_bytes(rows, length=50):
    rows = [(i if i is not None else 1 << 62, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in sorted(rows):
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found_bytes(rows):
    return sorted((r.doc_id if r.doc_id is not None else 1 << 62, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)


def shared_pieces(n, seed):
    rng = random.Random(seed)
    pool = [" ".join(words(k, seed * 100 + k)) for k in range(3, 40, 2)]
    return [(i, " ".join(rng.choice(pool) if rng.random() < 0.5 else " ".join(words(rng.randrange(1, 30), rng.random())) for _ in range(rng.randrange(1, 9)))) for i in range(n)]


def test_suffix_dedup_of_odd_rows(spark):
    assert found_bytes(suffix.dedup_substrings(table(spark)).collect()) == brute_bytes(ODD)


@pytest.mark.parametrize("seed,split", [(1, 256), (2, 2)])
def test_suffix_dedup_of_shared_pieces(spark, monkeypatch, seed, split):
    monkeypatch.setattr(suffix, "SPLIT", split)
    rows = shared_pieces(120, seed) + [(500 + i, "ab" * (20 + i)) for i in range(20)]
    got = suffix.dedup_substrings(table(spark, rows), keep_text=True).collect()
    assert found_bytes(got) == brute_bytes(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def said_twice():
    """Places that repeat inside one document, or under one id, and are known from an earlier document."""
    known = "the same forty words or so said over and over again here"  # 56 bytes
    about = f"{'<' * 5}left side of it {known} right side of it{'>' * 5}"
    rows = [(1, f"other place {known} and on"), (2, f"{about} {' '.join(words(20, 5))} {about} {' '.join(words(20, 6))} {about}")]
    rows += [(3, f"{' '.join(words(9, 7))} {about}"), (3, f"{' '.join(words(9, 8))} {about} {about}")]
    rows += [(11, "-" * 60), (12, "-" * 300), (13, f"start {'-' * 200} middle {'-' * 200}"), (14, "=-" * 100), (15, "=-" * 30 + "x" + "=-" * 90)]
    return rows + [(20 + i, f"{i}{known}{i * 7}" * 3) for i in range(9)]


@pytest.mark.parametrize("split", [0, 2, 4096])
def test_suffix_dedup_of_places_said_twice(spark, monkeypatch, split):
    monkeypatch.setattr(suffix, "SPLIT", split)
    for rows in (said_twice(), said_twice()[:2], [(1, "-" * 60), (2, "-" * 300)]):
        assert found_bytes(suffix.dedup_substrings(table(spark, rows)).collect()) == brute_bytes(rows)


def test_split_anchors_in_one_process():
    """Split and unsplit anchors give the same bytes."""
    texts = {i: (f"{i:04d}" * 12 + "the common phrase of more than twentyfour bytes " + f"{i % 3:04d}" * 12).encode() for i in range(40)}
    found = []
    for split in (1, 1000):
        old, suffix.SPLIT = suffix.SPLIT, split
        try:
            raw = np.frombuffer(b"".join(texts.values()), np.uint8)
            off = np.concatenate([[0], np.cumsum([len(t) for t in texts.values()])])
            who, pos, h, near = suffix.anchors(raw, off, 50, 24)
            ids, subs = np.arange(40), np.zeros(40, np.int32)
            table_ = suffix.match_anchors([suffix.pack(ids, subs, who, pos, h, near)], 50, 24)
        finally:
            suffix.SPLIT = old
        covered = {i: np.zeros(len(t), bool) for i, t in texts.items()}

        def mark(doc, spans):
            for a, b in np.frombuffer(spans, np.int32).reshape(-1, 2):
                covered[doc][a:b] = True

        import pyarrow as pa

        asked = [(r["doc"], r["wanted"]) for r in table_.to_pylist() if r["wanted"]]
        for r in table_.to_pylist():
            if r["spans"]:
                mark(r["doc"], r["spans"])
        some = [texts[d] for d, _ in asked]
        raw, off = np.frombuffer(b"".join(some), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in some])])
        seg = pa.Table.from_batches([suffix.segments_of([d for d, _ in asked], [0] * len(asked), raw, off, pa.array([w for _, w in asked], pa.binary()), 50, 24)])
        for r in seg.to_pylist():
            if not r["n_starts"]:
                covered[r["doc"]][r["start"] : r["upto"]] = True
        rest = seg.filter(pa.array([r > 0 for r in seg["n_starts"].to_pylist()]))
        for r in suffix.match_segments(rest, 50).to_pylist():
            mark(r["doc"], r["spans"])
        found.append({i: int(c.sum()) for i, c in covered.items()})
    assert found[0] == found[1]
    assert [(i, n) for i, n in found[0].items()] == [(i, n) for i, _, n, _, _ in brute_bytes([(i, t.decode()) for i, t in texts.items()])]


def test_ranges_hold_equal_shares_of_the_anchors():
    """Anchors have the smallest hashes of their windows; no range may hold most of them."""
    raw = np.frombuffer(" ".join(words(20_000, 3)).encode(), np.uint8)
    off = np.array([0, len(raw)])
    sent = {}
    for b in suffix.messages(np.array([1]), np.array([0]), [(0, *suffix.anchors(raw, off, 50, 24))], 5):
        for r, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            sent[r] = sent.get(r, 0) + len(m)
    assert len(sent) == 32 and max(sent.values()) < 1.5 * sum(sent.values()) / 32


def test_longest_previous_factor():
    texts = [b"abcabcabcX", b"abcabcabcY", b"bcabcabcX"]
    seg, off, factor = suffix.previous_factors(np.zeros(3, np.uint64), np.array([1, 2, 3]), texts, np.array([1, 1, 1]), 3)
    assert sorted(zip(seg.tolist(), off.tolist(), factor.tolist())) == [(1, 0, 9)]
    seg, off, factor = suffix.previous_factors(np.zeros(3, np.uint64), np.array([1, 2, 3]), texts, np.array([8, 8, 7]), 3)
    assert (2, 0, 9) in list(zip(seg.tolist(), off.tolist(), factor.tolist()))


def sets(rows):
    out = []
    for i, t in rows:
        w = (t or "").split()
        out.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def brute_classes(rows):
    s = sets(rows)
    label = list(range(len(s)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            both = len(s[a][1] & s[b][1])
            if both and both >= 0.8 * (len(s[a][1]) + len(s[b][1]) - both):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    groups = {}
    for k in range(len(s)):
        groups.setdefault(root(k), []).append(s[k][0])
    key = lambda i: (i is None, i or 0)
    return sorted((key(i), key(min(v, key=key)), len(v)) for v in groups.values() for i in v)


def near_rows():
    """Chains of copies with one more change each, in which only neighbours are alike."""
    rows = list(ODD)
    for g in range(6):
        text = " ".join(words(150, 50 + g))
        for k in range(12):
            rows.append((100 + 20 * g + k, text))
            w = text.split()
            for p in random.Random(g * 100 + k).sample(range(150), 2 if g % 2 else 3):
                w[p] = f"new{g}.{k}.{p}"
            text = " ".join(w)
    return rows


def test_near_duplicate_classes(spark):
    rows = near_rows()
    got = neardup.near_duplicates(table(spark, rows)).collect()
    key = lambda i: (i is None, i or 0)
    assert sorted((key(r.doc_id), key(r.class_id), r.class_size) for r in got) == brute_classes(rows)
    kept = {}
    for r in got:
        if r.kept:
            kept[r.class_id, r.words_hash] = kept.get((r.class_id, r.words_hash), 0) + 1
    n_classes = len({(r.class_id) for r in got if r.doc_id not in (3, 4, 5)})
    assert sum(r.kept for r in got if r.doc_id not in (3, 4, 5)) == len(kept) - len({3, 4, 5} & {r.doc_id for r in got if r.kept}) or n_classes


def test_one_document_of_each_class_stays(spark):
    rows = near_rows()
    docs = table(spark, rows)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    want = sorted({c for _, c, _ in brute_classes([r for r in rows if (r[1] or "").split()])}) + [(False, i) for i in (3, 4, 5)]
    # rows 2 stand for two texts in two classes
    assert sorted((i is None, i or 0) for i in ids) == sorted(want + [(False, 2)] * (ids.count(2) - want.count((False, 2))))


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 62, 200).astype(np.uint64)
    wa, wb = rng.random(200) * 3 + 0.1, rng.random(200) * 3 + 0.1
    sig = neardup.signatures(np.concatenate([a, a]), np.array([200, 200]), np.concatenate([wa, wb]), k=1024)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.06
    short = neardup.signatures(a[:1], np.array([1]))
    assert (short != 0).all()


def test_shingle_hashes_follow_words():
    texts = ["a b c d e f", "a  b c\td e f", "a b", "", "b", "a b c d e", "a b c d e f g"]
    made = []
    for t in texts:
        raw = t.encode()
        made.append(shingles.shingle_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist())
    assert made[0] == made[1] and len(made[0]) == 2 and len(made[2]) == 1 and not made[3] and made[2] != made[4]
    assert made[5] == made[0][:1] and made[6][:2] == made[0]
    joined = " ".join(texts[:3]).encode()
    flat, counts = shingles.shingle_hashes(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0] + [len(t.encode()) for t in texts]))
    assert counts.tolist() == [len(m) for m in made] and flat.tolist() == sum(made, []) and joined


def test_fuzzy_passages_are_found(spark):
    docs = table(spark)
    got = chaining.fuzzy_passages(docs).collect()
    pairs = {(r.doc_id, r.source_id) for r in got}
    assert {(7, 6), (10, 9), (11, 9)} <= pairs
    assert (8, 6) in pairs
    flagged = {r.doc_id for r in got}
    assert flagged <= {7, 8, 10, 11}
    by = {(r.doc_id, r.source_id): r for r in got}
    assert (by[10, 9].start, by[10, 9].n_words, by[10, 9].source_start) == (0, 70, 2)
    assert by[11, 9].start == 4 and by[11, 9].n_words == 70 and by[11, 9].identity >= 0.9
    assert chaining.fuzzy_passages(docs.limit(0)).count() == 0


def test_partners_beyond_first_and_previous(spark):
    """The only document with the whole passage is neither the first nor the previous holder of its halves."""
    a, b = " ".join(words(34, 71)), " ".join(words(34, 72))
    fill = lambda s: " ".join(words(60, s))
    rows = [
        (1, f"{fill(1)} {a} {fill(2)}"),
        (2, f"{fill(3)} {b} {fill(4)}"),
        (3, f"{fill(5)} {a} {b} {fill(6)}"),
        (4, f"{fill(7)} {a} {fill(8)}"),
        (5, f"{fill(9)} {b} {fill(10)}"),
        (6, f"{fill(11)} {a} {b} {fill(12)}"),
        (7, fill(13)),
    ]
    got = chaining.fuzzy_passages(table(spark, rows)).collect()
    assert {(r.doc_id, r.source_id) for r in got} == {(6, 3)}
    assert (got[0].start, got[0].n_words) == (60, 68)


def test_every_two_variants_of_a_passage_are_linked(spark):
    """Six versions of a passage, each with other words changed, and copies of one of them."""
    rows, base = [], words(120, 500)
    for i in range(6):
        piece = list(base)
        for at in (20 + 3 * i, 60 + 3 * i, 100 + 3 * i):
            piece[at] = f"only{i}at{at}"
        rows.append((i, f"{' '.join(words(40, 510 + i))} {' '.join(piece)} {' '.join(words(40, 520 + i))}"))
    middle = rows[2][1].split()[40:160]
    rows += [(6 + i, f"{' '.join(words(40, 530 + i))} {' '.join(middle)} {' '.join(words(40, 540 + i))}") for i in range(4)]
    got = chaining.fuzzy_passages(table(spark, rows)).collect()
    assert {(i, j) for i in range(6) for j in range(i)} <= {(r.doc_id, r.source_id) for r in got}
    copies = {r.doc_id for r in got if r.identity == 1.0 and r.source_id in (2, 6, 7, 8)}
    assert copies == {6, 7, 8, 9}


def test_windows_across_two_copies_stay_open():
    here, whole = np.arange(0, 97), np.array([[0, 60], [40, 100]])
    free = np.nonzero(chaining.open_places(here, whole, 50, 5))[0]
    assert (free[0], free[-1]) == (16, 80)  # windows from 16 to 34
    assert not chaining.open_places(here[:57], whole, 50, 5).any()
    assert chaining.open_places(here, np.zeros((0, 2), np.int64), 50, 5).all()


def test_places_of_seeds_that_a_partner_repeats_often(spark):
    """An entry of a templated text is quoted; each of its parts stands in many entries, together only in one."""
    lines = [" ".join(words(8, 80 + k)) for k in range(5)]
    fills = [[" ".join(words(4, 90 + 3 * k + v)) for v in range(3)] for k in range(4)]

    def entry(*v):
        return " ".join([f"{line} {fills[k][v[k]]}" for k, line in enumerate(lines[:4])] + lines[4:])

    made = [entry(a, b, c, d) for a in range(3) for b in range(3) for c in range(3) for d in range(3)]
    text = " ".join(f"{m} {' '.join(words(30, 900 + i))}" for i, m in enumerate(made))
    quoted = f"{' '.join(words(20, 61))} {entry(2, 1, 2, 1)} {' '.join(words(20, 62))}"
    got = [r for r in chaining.fuzzy_passages(table(spark, [(1, text), (2, quoted)])).collect() if r.identity == 1.0]
    want = made.index(entry(2, 1, 2, 1)) * 86
    assert [(r.doc_id, r.source_id, r.start, r.n_words, r.source_start) for r in got] == [(2, 1, 20, 56, want)]


def exact_windows(rows, n):
    first, out = {}, []
    for i, t in rows:
        w = (t or "").split()
        for p in range(len(w) - n + 1):
            if first.setdefault(tuple(w[p : p + n]), i) < i:
                out.append((i, p))
    return out


def test_every_exact_window_is_covered(spark):
    rows = shared_pieces(150, 9)
    rows += [(200 + i, f"{' '.join(words(9, 300 + i))} {PASSAGE} {' '.join(words(9, 400 + i))}") for i in range(15)]
    cover = {}
    for r in chaining.fuzzy_passages(table(spark, rows)).collect():
        cover.setdefault(r.doc_id, []).append((r.start, r.start + r.n_words))
    missed = [(i, p) for i, p in exact_windows(rows, 50) if not any(a <= p and p + 50 <= b for a, b in cover.get(i, []))]
    assert not missed


def test_chain_prefers_collinear_fragments():
    frag = np.array([[0, 20, 100, 120], [25, 45, 125, 145], [26, 40, 10, 24], [50, 70, 150, 170]])
    best = chaining.chains(frag)[0]
    assert best.tolist() == [[0, 20, 100, 120], [25, 45, 125, 145], [50, 70, 150, 170]]
    assert len(chaining.cut_chain(np.array([[0, 20, 0, 20], [90, 120, 90, 120]]), 24)) == 2


def test_long_texts_compare_whole():
    assert len(LONG.split()) == 30_000 and changed(LONG, 100) != LONG


def test_recall_of_changed_passages(spark):
    """Plants of random words with replaced words; the first and last word stay, as a passage ends in matches."""
    rng = np.random.default_rng(11)
    rows, cells = [], {}
    fresh = lambda n: [f"w{v}" for v in rng.integers(0, 10**9, n)]
    for n in (50, 100, 200):
        for identity in (0.8, 0.85, 0.9):
            for even in (False, True):
                for _ in range(12):
                    base, m = fresh(n), int(n * (1 - identity) + 1e-9)
                    at = [round((k + 1) * n / (m + 1) - 0.5) for k in range(m)] if even else rng.choice(np.arange(1, n - 1), m, replace=False)
                    other = list(base)
                    for k, w in zip(at, fresh(m)):
                        other[k] = w
                    rows += [(len(rows) + i, " ".join(fresh(40) + piece + fresh(40))) for i, piece in enumerate((base, other))]
                    cells.setdefault((n, identity, even), []).append(len(rows) - 1)
    got = {r.doc_id: r.source_id for r in chaining.fuzzy_passages(table(spark, rows)).collect()}
    assert all(src == doc - 1 for doc, src in got.items())
    recall = {cell: sum(d in got for d in docs) / len(docs) for cell, docs in cells.items()}
    print(recall)
    assert all(v >= 0.9 for (n, identity, _), v in recall.items() if n >= 100 and identity >= 0.85)
    assert np.mean(list(recall.values())) >= 0.9
    assert min(recall.values()) >= 0.5
