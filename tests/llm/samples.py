"""Rows shared by the tests: nulls, blanks, repeats, ties, a very long text, clashing columns."""

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size long, node string, h long, term string, "
    "_text string, _id string, sub int, hub string, run int, kept boolean"
)


def words(n, seed):
    rng = random.Random(seed)
    return [rng.choice("alpha bravo delta gamma kappa lima oscar quebec tango zulu".split()) + str(rng.randrange(500)) for _ in range(n)]


LONG = " ".join(words(30_000, 1))
PASSAGE = " ".join(words(70, 2))


def changed(text, every):
    w = text.split(" ")
    w[every // 2 :: every] = ["changed"] * len(w[every // 2 :: every])
    return " ".join(w)


ODD = [
    (1, "one  two\tthree four five six"),
    (2, "one two three four five six"),
    (2, "one two three four five six"),
    (2, "another text under the same id"),
    (None, "one two three four five six"),
    (None, "one two three four five six"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, LONG),
    (7, LONG),
    (8, changed(LONG, 100)),
    (9, "start here " + PASSAGE + " and end there"),
    (10, PASSAGE),
    (11, "quite other words before " + changed(PASSAGE, 20) + " with more behind"),
    (12, "x" * 300),
    (13, "x" * 120 + "é" * 40),
    (14, "ünïcödé 日本語 words that are short"),
    (15, "123 456 ... !!!"),
    (16, "<|im_end|> \\n \\\\ <\\| end"),
]


def table(spark, rows=ODD, langs=None, sources=None):
    """Documents with extra columns whose names the operators use themselves."""
    made = []
    for i, (doc_id, text) in enumerate(rows):
        lang = langs[i] if langs else ("en" if i % 3 else None)
        source = sources[i] if sources else (None, "b", "a", "ü")[i % 4]
        made.append((doc_id, text, lang, source, 0, -1, "n", 7, "t", "x", "y", 3, "hub", 9, False))
    return spark.createDataFrame(made, SCHEMA).repartition(3)
