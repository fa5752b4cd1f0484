"""Spelling variants: words one edit apart, found on dense tiles of code points.

Two words are one edit apart if their common prefix and suffix together reach the length of the
longer one minus one. Which pairs to compare follows from the same rule. Take the shorter
length ``m`` (the other is ``m`` or ``m + 1``): the pair agrees on its first ``m // 2``
code points, or else on its last ``m // 2``. Each word enters the groups of its own
length and of the length below, by prefix and by suffix, so every near pair meets, and
one that agrees on both sides counts in the prefix group only.

A group larger than a tile is not compared but cut again: without the part its members
share, the same rule holds for what is left in the middle, so halves of it
give smaller groups. This ends at a middle of one code point, where a group is bounded by the
alphabet. No group of the vocabulary is ever compared pair by pair beyond a tile, and
only near pairs leave a task.

In a task, the words of many groups lie in one padded matrix, sorted by group; row ``i`` is compared with
row ``i + d`` for all rows at once, ``d`` up to the largest group.

Cases: null text has no words; words of equal count go to the smaller in code-point order
(UTF-8 byte order); rows that repeat an id count each; a null id hashes as an empty one; very long
words are words like others (tiles are bounded by bytes); an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlake.llm.common import parallelism, stage
from hazardlake.llm.contamination import lowered

# fixed values: letters, least length and the simulated slip of the contract
LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST = 7
EVERY = 31
TILE = 256  # words of a group that is compared; larger ones are cut
CELLS = 4 << 20  # code points of one matrix
PAIRS = pa.schema([("word", pa.string()), ("near", pa.string())])


def word_counts(docs: DataFrame, id_col: str, text_col: str, least: int = LEAST, every: int = EVERY) -> DataFrame:
    """word, n: runs of letters with the simulated slip, A-Z lowered, at least ``least`` long."""
    runs = F.regexp_extract_all(lowered(F.coalesce(F.col(text_col), F.lit(""))), F.lit(f"({LETTERS}{{{least},}})"), F.lit(1))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.pmod(h, F.length("run"))).cast("int")
    slipped = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = rows.select(F.when(h % every == 0, slipped).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def cut_groups(members: DataFrame) -> DataFrame:
    """Each group by the two halves of its middle.

    ``members``: word, m, a, b (code points shared in front, behind), path (the cuts so far as
    bits behind a leading one, 0 for front).
    """
    half = F.floor((F.col("m") - F.col("a") - F.col("b")) / 2).cast("int")
    side = lambda a, b, bit: F.struct((F.col("a") + a).alias("a"), (F.col("b") + b).alias("b"), (F.col("path") * 2 + bit).alias("path"))
    sides = F.array(side(half, F.lit(0), F.lit(0)), side(F.lit(0), half, F.lit(1)))
    return members.select("word", "m", F.explode(sides).alias("s")).select("word", "m", "s.a", "s.b", "s.path")


def with_key(members: DataFrame) -> DataFrame:
    """What the members of a group share, as a 64-bit hash."""
    word, n = F.col("word"), F.length("word")
    shared = [F.substring(word, F.lit(1), F.col("a")), F.substring(word, n - F.col("b") + 1, F.col("b"))]
    return members.withColumn("key", F.xxhash64("m", "path", *shared))


def groups(vocabulary: DataFrame, tile: int) -> DataFrame:
    """word, m, a, b, path, key: members of groups of at most ``tile`` words or with a middle of one code point."""
    n = F.length("word")
    start = vocabulary.select("word", F.explode(F.array(n, n - 1)).alias("m")).select("word", "m", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(1).cast("bigint").alias("path"))
    open_, done = cut_groups(start), None
    while True:
        members = stage(with_key(open_), "spelling-groups")
        sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max(F.col("m") - F.col("a") - F.col("b")).alias("middle"))
        large = stage(sizes.filter((F.col("size") > tile) & (F.col("middle") > 1)).select("key"), "spelling-large")
        if large.isEmpty():
            return members if done is None else done.unionByName(members)
        small = members.join(large, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        open_ = cut_groups(members.join(large, "key", "left_semi"))


def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common prefix of every pair of rows."""
    other = x != y
    return np.where(other.any(axis=1), other.argmax(axis=1), x.shape[1])


def tile_pairs(codes: np.ndarray, length: np.ndarray, key: np.ndarray, m: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs (i, j) of rows sorted by key.

    ``codes``: padded code points. ``path``: the cuts of every row's group.
    """
    width = codes.shape[1]
    # the same words, padded in front, so that suffixes line up
    back = np.take_along_axis(codes, (np.arange(width)[None, ::-1] - (width - length)[:, None]) % width, axis=1)
    back = np.where(np.arange(width)[None, :] < length[:, None], back, np.uint32(0))
    left, right, rows = [], [], np.arange(len(codes))
    d = 1
    while True:
        rows = rows[rows + d < len(codes)]
        rows = rows[key[rows] == key[rows + d]]
        if not len(rows):
            break
        short = np.minimum(length[rows], length[rows + d])
        # two words of length m + 1 belong to the group of m + 1
        at = rows[short == m[rows]]
        if len(at):
            long = np.maximum(length[at], length[at + d])
            pre = common(codes[at], codes[at + d])
            suf = common(back[at], back[at + d])
            # padding equals padding: words of one length may agree on it
            pre, suf = np.minimum(pre, m[at]), np.minimum(suf, m[at])
            near = pre + suf >= long - 1
            at, pre = at[near], pre[near]
            # a pair that agrees in front is counted there, at every cut
            ok = first_group(pre, m[at], path[at])
            left.append(at[ok])
            right.append(at[ok] + d)
        d += 1
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def first_group(pre: np.ndarray, m: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Whether a pair with common prefix ``pre`` belongs to this group: redo the cuts.

    At every cut a pair that agrees on the first half of the middle goes to the front, else behind.
    """
    a, b, way = np.zeros_like(m), np.zeros_like(m), np.ones_like(m)
    while True:
        going = way < path
        if not going.any():
            return way == path
        half = (m - a - b) // 2
        behind = pre < a + half
        a = np.where(going & ~behind, a + half, a)
        b = np.where(going & behind, b + half, b)
        way = np.where(going, 2 * way + behind, way)


def near_pairs(members: DataFrame) -> DataFrame:
    """word, near: all pairs of words one edit apart, in both directions, each once."""

    def compare(table: pa.Table) -> pa.Table:
        words = table.column("word").to_pylist()
        key = table.column("key").to_numpy()
        m, path = (table.column(c).to_numpy().astype(np.int64) for c in ("m", "path"))
        length = np.fromiter(map(len, words), np.int64, len(words))
        order = np.lexsort((length, key))
        out = [[], []]
        # whole groups, up to CELLS code points at a time
        ends = np.flatnonzero(np.append(np.diff(key[order]) != 0, True)) + 1 if len(order) else np.zeros(0, np.int64)
        start = 0
        while start < len(order):
            first = int(np.searchsorted(ends, start, "right"))
            stop, widest = start, 0
            while first < len(ends):
                widest = max(widest, int(length[order[stop : ends[first]]].max()))
                if stop > start and widest * (ends[first] - start) > CELLS:
                    break
                stop, first = int(ends[first]), first + 1
            at = order[start:stop]
            text = np.array([words[i] for i in at])
            codes = text.view(np.uint32).reshape(len(at), -1)
            i, j = tile_pairs(codes, length[at], key[at], m[at], path[at])
            for x, y in ((i, j), (j, i)):
                out[0] += [words[k] for k in at[x]]
                out[1] += [words[k] for k in at[y]]
            start = stop
        return pa.Table.from_arrays([pa.array(c, pa.string()) for c in out], schema=PAIRS)

    n = 4 * parallelism(members.sparkSession)
    dealt = members.withColumn("r", F.pmod("key", F.lit(n)))
    return dealt.groupBy("r").applyInArrow(compare, "word string, near string")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms; counts grow tenfold per step, so chains are short."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        nxt = stage(now.alias("x").join(now.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left"), "spelling-roots")
        moved = nxt.filter("further IS NOT NULL")
        now = nxt.select("word", F.coalesce("further", "root").alias("root"))
        if moved.isEmpty():
            return now


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_count: int = 2, ratio: int = 10, tile: int = TILE
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    vocabulary = stage(word_counts(docs, id_col, text_col).filter(F.col("n") >= least_count), "spelling-words")
    pairs = near_pairs(groups(vocabulary, tile)).join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    found = vocabulary.join(near, "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    found = stage(found.withColumns({"form": F.when(enough, F.col("best.near")), "form_n": F.when(enough, -F.col("best.less"))}), "spelling-forms")
    ends = roots(found.filter("form IS NOT NULL"))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n"
    )
