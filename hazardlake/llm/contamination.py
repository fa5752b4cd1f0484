"""Benchmark decontamination with a positional inverted index.

A window is 13 consecutive words of an item (an item of fewer words is one
window). Every window is looked up by its two rarest terms: postings (term,
document, position) are stored for these terms only, moved back by the term's
offset in the item, and intersected per (document, item, alignment). What is
left holds both terms at the right distance; the item's other words are then
compared at their places, which gives the exact windows.

Postings are counted first (a term that the corpus lacks ends its windows), so
common words enter the index only if a window has nothing rarer. The work is
linear in the postings of the rarest terms: no document meets another one, and a passage
in a third of all documents gives one alignment per document and rare term.
Term tables are broadcast only below a checked number of rows.

`proximity_matches` reads the same index: places where the rarest terms of an
item stand within a few words of each other in any order.

Cases: null text has no words; an item without words has no window; an item
without id is listed under the empty string; rows that repeat id and text get
equal results; empty tables give no hits; other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardlake.llm.common import join_same, small, stage

WINDOW = 13
# fixed values: the separators around the contract's words, before letters are lowered
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Index(NamedTuple):
    items: DataFrame  # tid, words (one row per distinct item text)
    names: DataFrame  # tid, item_id
    needs: DataFrame  # tid, needs: offsets of the rarest terms of every window
    rare: DataFrame  # tid, term: the rarest terms of the item
    postings: DataFrame  # term, doc, h, pos


def lowered(word: Column) -> Column:
    """A-Z to a-z, other letters as they are."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def raw_words(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), SEPARATORS)


def word_count(words: Column) -> Column:
    """Number of words in a split text, which may begin and end with an empty part."""
    n = F.size(words)
    ends = F.when(F.get(words, F.lit(0)) == "", 1).otherwise(0) + F.when((n > 1) & (F.element_at(words, -1) == ""), 1).otherwise(0)
    return n - ends


def build_index(docs: DataFrame, bench: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, n_rare: int = 3) -> Index:
    words = F.filter(F.transform(raw_words(F.col(item_text_col)), lowered), lambda w: w != "")
    named = bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"), words.alias("words"))
    named = named.filter(F.size("words") > 0).withColumn("tid", F.sha2(F.concat_ws(" ", "words"), 256))
    names = stage(named.select("tid", "item_id").distinct(), "item-names")
    items = stage(named.groupBy("tid").agg(F.first("words").alias("words")), "items")

    terms = items.select(F.explode("words").alias("term")).distinct()
    every = docs.select(F.explode(raw_words(F.col(text_col))).alias("term")).select(lowered(F.col("term")).alias("term"))
    found = stage(every.join(small(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term-counts")

    # rarest offsets of every window; items are short lists, so this stays inside a row
    placed = items.select("tid", F.size("words").alias("n"), F.posexplode("words").alias("off", "term"))
    placed = placed.join(found, "term", "left")
    listed = placed.groupBy("tid", "n").agg(F.sort_array(F.collect_list(F.struct("off", "df", "term"))).alias("at"))
    length = F.least(F.lit(WINDOW), F.col("n"))
    starts = F.sequence(F.lit(0), F.col("n") - length)
    spans = F.transform(starts, lambda j: F.slice("at", j + 1, length))
    spans = F.filter(spans, lambda w: F.forall(w, lambda x: x["df"].isNotNull()))
    by_rarity = lambda w: F.slice(F.array_sort(F.transform(w, lambda x: F.struct(x["df"].alias("df"), x["off"].alias("off")))), 1, 2)
    needs = F.array_distinct(F.transform(spans, lambda w: F.array_sort(F.transform(by_rarity(w), lambda x: x["off"]))))
    needs = stage(listed.select("tid", needs.alias("needs")).filter(F.size("needs") > 0), "needs")
    seen = F.filter("at", lambda x: x["df"].isNotNull())
    order = F.array_sort(F.array_distinct(F.transform(seen, lambda x: F.struct(x["df"].alias("df"), x["term"].alias("term")))))
    rare = stage(listed.select("tid", F.explode(F.slice(order, 1, n_rare)).alias("x")).select("tid", "x.term"), "rare-terms")

    offs = needs.select("tid", F.explode(F.array_distinct(F.flatten("needs"))).alias("off"))
    wanted = offs.join(items, "tid").select(F.get("words", F.col("off")).alias("term")).union(rare.select("term")).distinct()
    text = F.col(text_col)
    tokens = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("h"), F.posexplode(raw_words(text)).alias("pos", "term"))
    tokens = tokens.withColumn("term", lowered(F.col("term")))
    postings = stage(tokens.join(small(stage(wanted, "wanted-terms")), "term").select("term", "doc", "h", "pos"), "postings")
    return Index(items, names, needs, rare, postings)


def alignments(index: Index) -> DataFrame:
    """doc, h, tid, shift: places where the rarest terms of a window stand right."""
    offs = index.needs.select("tid", F.explode(F.array_distinct(F.flatten("needs"))).alias("off"))
    offs = offs.join(index.items, "tid").select("tid", "off", F.get("words", F.col("off")).alias("term"))
    moved = index.postings.join(small(offs), "term").select("doc", "h", "tid", (F.col("pos") - F.col("off")).alias("shift"), "off")
    met = moved.groupBy("doc", "h", "tid", "shift").agg(F.collect_set("off").alias("offs"))
    whole = lambda need: F.size(F.array_except(need, F.col("offs"))) == 0
    return met.join(small(index.needs), "tid").filter(F.exists("needs", whole)).select("doc", "h", "tid", "shift")


def exact_matches(docs: DataFrame, index: Index, id_col: str, text_col: str) -> DataFrame:
    """doc, h, tid, start, n_words: every occurrence of a window."""
    found = stage(alignments(index), "alignments")
    text = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h"))
    # equal rows would repeat their matches
    some = found.select("doc", "h").distinct()
    cond = ["doc", "h"]
    text = join_same(text, small(some), cond)
    text = text.groupBy("doc", "h").agg(F.first("text").alias("text"))
    at = join_same(text.select("doc", "h", raw_words(F.col("text")).alias("raw")), found, cond).join(small(index.items), "tid")
    # a window may begin before the first or end after the last word: those places do not match
    n = F.size("words")
    here = lambda o: lowered(F.get("raw", F.col("shift") + o))
    same = F.transform(F.sequence(F.lit(0), n - 1), lambda o: (F.col("shift") + o >= 0) & here(o).eqNullSafe(F.get("words", o)))
    rows = at.select("doc", "h", "tid", "shift", same.alias("same"), F.least(F.lit(WINDOW), n).alias("len"), n.alias("n"))
    good = F.filter(F.sequence(F.lit(0), F.col("n") - F.col("len")), lambda j: F.forall(F.slice("same", j + 1, F.col("len")), lambda x: x))
    hits = rows.select("doc", "h", "tid", "shift", F.col("len").alias("n_words"), F.explode(good).alias("j"))
    return hits.select("doc", "h", "tid", (F.col("shift") + F.col("j")).alias("start"), "n_words")


def proximity_matches(index: Index, slop: int = 24) -> DataFrame:
    """doc, h, item_id, start, end: the item's rarest terms within ``slop`` words, in any order."""
    counted = index.rare.groupBy("tid").agg(F.count(F.lit(1)).alias("n_rare"))
    near = index.postings.join(small(index.rare), "term").join(small(counted), "tid")
    w = Window.partitionBy("doc", "h", "tid").orderBy("pos").rangeBetween(0, slop)
    near = near.withColumns({"terms": F.size(F.collect_set("term").over(w)), "end": F.max("pos").over(w)})
    return near.filter(F.col("terms") == F.col("n_rare")).join(index.names, "tid").select("doc", "h", "item_id", F.col("pos").alias("start"), "end")


def contamination(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    index = build_index(docs, bench, id_col, text_col, item_col, item_text_col)
    hits = stage(exact_matches(docs, index, id_col, text_col), "matches")
    words = hits.select("doc", "h", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n_words") - 1)).alias("pos"))
    n_hit = words.distinct().groupBy("doc", "h").agg(F.count(F.lit(1)).alias("n_hit"))
    items = hits.select("doc", "h", "tid").distinct().join(index.names, "tid")
    items = items.groupBy("doc", "h").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    found = stage(join_same(n_hit, items, ["doc", "h"]), "hits")
    text = F.col(text_col)
    all_docs = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("h"), word_count(raw_words(text)).cast("bigint").alias("n_words"))
    zero = F.lit(0).cast("bigint")
    out = join_same(all_docs, found, ["doc", "h"], "left").withColumn("n_hit", F.coalesce("n_hit", zero))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("doc").alias(id_col),
        "n_words",
        "n_hit",
        F.size(listed).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.col("h").alias("text_hash"),
    )


def keep_clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    found = contamination(docs.select(id_col, text_col), bench, id_col, text_col)
    bad = found.filter("contaminated").select(F.col(id_col).alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct()
    same = F.col(id_col).eqNullSafe(F.col("_bad_id")) & (F.xxhash64(F.col(text_col)) == F.col("_bad_hash"))
    return docs.join(small(stage(bad, "contaminated")), same, "left_anti")
