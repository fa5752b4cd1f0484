"""License scans: phrases, and an exact set-similarity join of text blocks with templates.

A block is ``block`` consecutive words of a text, one beginning every half block,
so any stretch of half a block lies whole in one of them, whatever the line
breaks. A template is a set of words; a block meets it if it holds at least
``threshold`` of them. The join finds every such pair:

1. The words of all templates are counted in the whole corpus. This gives the
   global order, rarest first.
2. Prefix: a template that needs ``o`` of its ``n`` words shares one of its
   ``n - o + 1`` rarest with every block that meets it. Only blocks around such a
   word leave their row, as the list of their template words in global order.
3. A hash join on the words of both prefixes gives candidates. A block with fewer
   than ``o`` template words (length filter), or whose rest behind the shared word
   is too short in block or template (positional filter), is dropped.
4. The overlap of what is left is counted.

Texts are read twice and never shuffled. Template words are part of the plan,
so their number is checked; all other tables grow with the matches only.

Cases: null text has no words; an empty text gets zeros, nulls and empty labels;
templates without words are ignored, those that share a label are alternatives; a
text shorter than a block is one block; rows that repeat id and text get equal
results; a null id is an id; an empty table gives an empty result; with no
template the phrases are left; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlake.llm.common import join_same, small, stage
from hazardlake.llm.contamination import SEPARATORS, lowered

# fixed values: phrases and labels of the contract
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
# fixed values: notices by which licenses announce themselves
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
]
BLOCK = 64
THRESHOLD = 0.9
MOST_WORDS = 100_000  # distinct words of all templates: a few megabytes of plan


def text_words(text: Column) -> Column:
    """Words of a text, A-Z lowered; null has none."""
    return F.filter(F.split(lowered(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def prepared(spark, templates: Sequence[tuple[str, str]] | DataFrame, threshold: float) -> DataFrame:
    """tid, label, words (distinct), need: one row per template that has words."""
    if not isinstance(templates, DataFrame):
        templates = spark.createDataFrame(list(templates), "label string, text string")
    t = templates.select("label", F.array_distinct(text_words(F.col("text"))).alias("words")).filter(F.size("words") > 0)
    # a hair is taken off so that 0.9 of ten words are nine
    need = F.greatest(F.lit(1), F.ceil(F.size("words") * threshold - 1e-9)).cast("int")
    t = t.select(F.sha2(F.concat_ws(" ", F.coalesce("label", F.lit("")), F.array_sort("words")), 256).alias("tid"), "label", "words", need.alias("need"))
    return t.dropDuplicates(["tid"])


def global_order(docs: DataFrame, text_col: str, templates: DataFrame) -> list[str]:
    """All template words, rarest in the corpus first."""
    vocabulary = templates.select(F.explode("words").alias("word")).distinct()
    # bounded by the templates, which are a parameter
    if vocabulary.count() > MOST_WORDS:
        raise ValueError(f"templates hold more than {MOST_WORDS} distinct words")
    every = docs.select(F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), SEPARATORS)).alias("w")).select(lowered(F.col("w")).alias("word"))
    counts = every.join(small(vocabulary), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counted = vocabulary.join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))
    return [r.word for r in sorted(counted.collect(), key=lambda r: (r.n, r.word))]


def in_order(order: list[str], words: Column) -> Column:
    """The words of ``order`` that ``words`` holds, in the order of ``order``."""
    return F.array_intersect(F.array(*[F.lit(w) for w in order]).cast("array<string>"), words)


def scan(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] | DataFrame = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """(texts, blocks): a row per document with its phrases, a row per pair of block and template.

    texts: doc, h, n_words, places (label, start); blocks: doc, h, start, tid, label, overlap, containment.
    """
    spark, half = docs.sparkSession, block // 2
    templates = stage(prepared(spark, templates, threshold), "license-templates")
    order = global_order(docs, text_col, templates)
    sorted_words = in_order(order, F.col("words")) if order else F.col("words")
    templates = templates.select("tid", "label", "need", sorted_words.alias("words"), F.size("words").alias("n"))
    prefixes = templates.select("tid", "label", "need", "words", "n", F.posexplode(F.slice("words", 1, F.col("n") - F.col("need") + 1)).alias("i", "word"))
    # bounded by the templates
    rare = sorted({r.word for r in prefixes.select("word").distinct().collect()})
    least = templates.agg(F.min("need")).first()[0] or 1

    said = [(label, text.split(" ")) for text, label in phrases]
    marked = sorted({*rare, *[p[-1] for _, p in said]})
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("h"), text_words(text).alias("w"))
    n = F.size("w")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    here = F.filter(places, lambda i: F.get("w", i).isin(marked)) if marked else F.array().cast("array<int>")
    rows = rows.select("doc", "h", "w", n.alias("n"), here.alias("at"))

    def starts(label: str, words: list[str]) -> Column:
        last = len(words) - 1
        fits = lambda i: F.forall(F.array(*[F.get("w", i - last + k) == word for k, word in enumerate(words)]), lambda x: F.coalesce(x, F.lit(False)))
        found = F.filter("at", lambda i: (i >= last) & (F.get("w", i) == words[-1]) & fits(i))
        return F.transform(found, lambda i: F.struct(F.lit(label).alias("label"), (i - last).alias("start")))

    spoken = F.concat(*[starts(label, words) for label, words in said]) if said else F.array().cast("array<struct<label:string,start:int>>")
    # the last block begins where a whole block still fits, or at 0
    final = F.greatest(F.lit(0), F.ceil((F.col("n") - block) / half)).cast("int")
    near = F.filter("at", lambda i: F.get("w", i).isin(rare)) if rare else F.array().cast("array<int>")
    cell = lambda i: F.floor(i / half).cast("int")
    numbers = F.array_distinct(F.flatten(F.transform(near, lambda i: F.array(F.least(cell(i), final), F.least(F.greatest(cell(i) - 1, F.lit(0)), final)))))
    listed = F.transform(numbers, lambda b: F.struct((b * half).alias("start"), in_order(order, F.slice("w", b * half + 1, block)).alias("words")))
    kept = F.filter(listed, lambda b: F.size(b["words"]) >= least)
    rows = stage(rows.select("doc", "h", F.col("n").cast("bigint").alias("n_words"), spoken.alias("places"), kept.alias("blocks")), "license-rows")

    cut = rows.filter(F.size("blocks") > 0).select("doc", "h", F.explode("blocks").alias("b")).select("doc", "h", "b.start", F.col("b.words").alias("b_words"))
    cut = cut.withColumn("b_n", F.size("b_words"))
    # the longest prefix any template needs; the positional filter shortens it for the others
    seeds = cut.select("*", F.posexplode(F.slice("b_words", 1, F.col("b_n") - least + 1)).alias("j", "word"))
    met = seeds.join(small(prefixes), "word").filter(
        (F.col("b_n") >= F.col("need")) & (1 + F.least(F.col("b_n") - 1 - F.col("j"), F.col("n") - 1 - F.col("i")) >= F.col("need"))
    )
    pairs = met.withColumn("overlap", F.size(F.array_intersect("b_words", "words"))).filter("overlap >= need")
    # a pair is met once per shared prefix word
    pairs = pairs.groupBy("doc", "h", "start", "tid").agg(F.first("label").alias("label"), F.first("overlap").alias("overlap"), F.first("n").alias("n"))
    blocks = pairs.select("doc", "h", "start", "tid", "label", "overlap", (F.col("overlap") / F.col("n")).alias("containment"))
    return rows.drop("blocks"), blocks


def license_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks.

    ``score`` is 1 with a phrase, else the best containment of a block that meets a template, else 0.
    ``options`` are those of `scan`.
    """
    rows, blocks = scan(docs, id_col=id_col, text_col=text_col, **options)
    best = blocks.groupBy("doc", "h").agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("best"), F.countDistinct("start").alias("n_blocks")
    )
    out = join_same(rows, best, ["doc", "h"], "left")
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    at = F.transform("places", lambda p: p["start"])
    joined = lambda a: F.concat_ws(",", F.array_sort(a))
    return out.select(
        F.col("doc").alias(id_col),
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(at).cast("bigint").alias("first_word"),
        F.array_max(at).cast("bigint").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.array_union(base, F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("n_blocks", F.lit(0)).cast("bigint").alias("n_blocks"),
    )
