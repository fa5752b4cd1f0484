import hashlib
import re

from samples import LONG, ODD, PASSAGE, table

from hazardlake.llm import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(t):
    return WORD.findall((t or "").translate(LOWER))


ITEMS = [
    (1, PASSAGE.upper()),
    (2, "four five six"),
    (2, "THREE, four!"),
    (3, None),
    (4, "..."),
    (5, "one two three nowhere else in the corpus at all but here my friend and so on"),
    (6, " ".join(LONG.split()[500:520])),
    (7, "ünïcödé 日本語"),
    (8, "ÜNÏCÖDÉ 日本語"),
    (9, PASSAGE),
    (None, "another text"),
]


def brute(docs):
    windows = {}
    for item, text in ITEMS:
        w = split(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    sizes = {len(k) for k in windows}
    out = []
    for doc_id, text in docs:
        w, hit, items = split(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i : i + n]))
                if found:
                    items |= found
                    hit |= set(range(i, i + n))
        ids = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((doc_id or -1, len(w), len(hit), len(items), ids, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def items(spark):
    return spark.createDataFrame([(i, t, "w", 5) for i, t in ITEMS], "item_id long, text string, words string, tid long")


def test_windows_against_brute_force(spark):
    got = contamination.contamination(table(spark), items(spark)).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == brute(ODD)


def test_clean_rows_are_kept_whole(spark):
    docs = table(spark)
    kept = contamination.keep_clean(docs, items(spark))
    assert kept.columns == docs.columns
    bad = {x[0] for x in brute(ODD) if x[5]}
    assert {r.doc_id or -1 for r in kept.collect()} == {x[0] for x in brute(ODD) if not x[5]} and bad


def test_empty_tables(spark):
    assert contamination.contamination(table(spark).limit(0), items(spark)).count() == 0
    rows = contamination.contamination(table(spark), items(spark).limit(0)).collect()
    assert len(rows) == len(ODD) and not any(r.n_hit for r in rows)


def test_proximity_in_any_order(spark):
    docs = table(spark, [(1, "zebra then yak and much later some filler words quokka"), (2, "quokka yak filler zebra"), (3, "zebra " + "filler " * 60 + "yak quokka")])
    bench = spark.createDataFrame([(1, "quokka zebra yak")], "item_id long, text string")
    index = contamination.build_index(docs, bench, "doc_id", "text", "item_id", "text")
    assert sorted({r.doc for r in contamination.proximity_matches(index, slop=10).collect()}) == [1, 2]
