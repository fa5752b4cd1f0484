"""Mixing sources to target weights with exact quotas.

Documents are cut into blocks of words. Each source gets a target number of
words: its share of the budget by weight, at most ``max_repeats`` times its own
size, what is cut off going to the others by weight. Whole passes over a source
take every block; the rest of its target takes the first blocks of a hashed
permutation, the last one in part, so the words taken equal the rounded target.

A splitting tree deals the draws to output shards. A node knows how many draws
of each source lie below it; its left child gets a multivariate hypergeometric
share of them, drawn source by source from what is left in the urn, and the
right child gets the rest. Shard sizes differ by one at most and quotas add up
exactly. The draws of a source, in permuted order, fill its quotas one after
the other, and every shard is shuffled on its own. All choices come from hashes
of identifiers, so reruns agree whatever the partitioning.

Positions in a source are counted in two levels (hash ranges, then inside a
range), so a source with a third of all rows is spread over many tasks. What
grows with sources and shards only (targets, quotas) is one row per source, or
one array over sources per tree node. Draws find their shards by the stretch of
indices they lie in, and are written with shard and position before anything
else reads them.

Cases: null text has size 0 and is never drawn; rows without source form one
source, which comes last; rows that repeat an id are separate documents; an
empty table gives empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardlake.functions.ordered import running_totals
from hazardlake.llm.common import NON_SPACES, join_same, power_of_two, stage

RANGES = 4096
STRETCH = 4096  # draws of a source that find their shards together


class Mix(NamedTuple):
    documents: DataFrame  # id, _row, source, size, source_size, target
    draws: DataFrame  # shard, position, id, _row, source, epoch, start_word, n_words


def uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) from hashed parts."""
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def hypergeometric(total: Column, marked: Column, drawn: Column, *key: Column | str) -> Column:
    """How many of ``drawn`` items out of ``total`` are among the ``marked`` ones, by inversion.

    Weights follow from their neighbours by the ratio of two probabilities. All counts within 12 standard deviations
    plus 40 of the mode take part; what lies beyond weighs less than the step of the uniform number.
    """
    long = lambda c: c.cast("bigint")
    low = F.greatest(F.lit(0).cast("bigint"), drawn - (total - marked))
    high = F.least(drawn, marked)
    share = marked / F.greatest(total, F.lit(1))
    spread = F.sqrt(F.greatest(drawn * share * (1 - share) * (total - drawn) / F.greatest(total - 1, F.lit(1)), F.lit(0.0)))
    mode = F.greatest(low, F.least(high, long(F.floor((drawn + 1.0) * (marked + 1.0) / (total + 2.0)))))
    reach = long(F.ceil(spread * 12)) + 40
    first, last = F.greatest(low, mode - reach), F.least(high, mode + reach)
    steps = F.sequence(first, F.greatest(first, last))
    ratio = lambda i: (marked - i).cast("double") * (drawn - i) / ((i + 1.0) * (total - marked - drawn + i + 1.0))
    one = F.lit(1.0)
    weighed = lambda acc, i: F.struct((acc["w"] * ratio(i)).alias("w"), (acc["sum"] + acc["w"]).alias("sum"))
    mass = F.aggregate(steps, F.struct(one.alias("w"), F.lit(0.0).alias("sum")), weighed)["sum"]
    start = F.struct(one.alias("w"), (uniform(*key) * mass).alias("left"), first.alias("k"))

    def walk(acc, i):
        left = acc["left"] - acc["w"]
        on = (left > 0) & (i < last)
        return F.struct(
            F.when(acc["left"] > 0, acc["w"] * ratio(i)).otherwise(0.0).alias("w"),
            F.when(on, left).otherwise(F.lit(-1.0)).alias("left"),
            F.when(on & (acc["left"] > 0), i + 1).otherwise(acc["k"]).alias("k"),
        )

    return F.aggregate(steps, start, walk)["k"]


def targets(sizes: DataFrame, weights: Sequence[float], budget_ratio: float, max_repeats: int) -> DataFrame:
    """source, source_size, target: shares by weight, cut at ``max_repeats`` sizes and shared again."""
    okey = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumns({"_order": okey, "_one": F.lit(1)})
    src = running_totals(src, [], "_order", ["_one"])
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_one_upto") - 1) % len(weights)).cast("int"))
    src = stage(src.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * max_repeats).alias("most")), "sources")
    whole = src.agg(F.sum("source_size"), F.sum("weight")).first()
    if not whole[0]:
        return src.select("source", "source_size", F.lit(0.0).alias("target"))
    budget = whole[0] * budget_ratio
    full, open_weight = 0.0, whole[1]
    while True:  # each round only two sums come back; a source that is full stays full
        level = lambda: F.col("weight") * budget_left / open_weight
        budget_left = budget - full
        row = src.agg(
            F.sum(F.when(F.col("most") <= level(), F.col("most")).otherwise(0)),
            F.sum(F.when(F.col("most") > level(), F.col("weight")).otherwise(0.0)),
        ).first()
        if not row[1] or (row[0] == full and row[1] == open_weight):
            break
        full, open_weight = float(row[0]), row[1]
    target = F.least(F.col("most").cast("double"), level())
    return src.select("source", "source_size", target.alias("target"))


def quotas(counts: DataFrame, n_shards: int, total: int, seed: str) -> DataFrame:
    """source, shard, from, to: the draws of the source, by their index, that every shard gets."""
    rows = counts.select(F.lit(0).alias("node"), "source", F.col("_draws").alias("k"))
    width = n_shards
    while width > 1:
        half = width // 2
        before = lambda shard: F.floor(shard * F.lit(total) / n_shards).cast("bigint")
        item = F.struct(F.col("source").isNull().alias("none"), "source", "k")
        node = rows.groupBy("node").agg(F.sort_array(F.collect_list(item)).alias("items"), F.sum("k").alias("all"))
        at = F.col("node").cast("bigint") * width
        node = node.withColumn("left", before(at + half) - before(at))
        start = F.struct(
            F.col("all").alias("urn"),
            F.col("left").alias("free"),
            F.array().cast("array<struct<source:string,k:bigint,l:bigint>>").alias("out"),
        )

        def step(acc, x):
            got = hypergeometric(acc["urn"], x["k"], acc["free"], seed, F.lit(width), F.col("node"), x["source"])
            made = F.array(F.struct(x["source"].alias("source"), x["k"].alias("k"), got.alias("l")))
            return F.struct(
                (acc["urn"] - x["k"]).alias("urn"), (acc["free"] - got).alias("free"), F.concat(acc["out"], made).alias("out")
            )

        split = node.select("node", F.explode(F.aggregate("items", start, step)["out"]).alias("s"))
        split = split.select("node", "s.source", "s.k", "s.l").withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
        part = F.when(F.col("side") == 0, F.col("l")).otherwise(F.col("k") - F.col("l"))
        rows = split.select((F.col("node") * 2 + F.col("side")).alias("node"), "source", part.alias("k"))
        width = half
    upto = F.sum("k").over(Window.partitionBy("source").orderBy("node"))
    rows = rows.filter("k > 0").withColumn("to", upto)
    return rows.select("source", F.col("node").cast("int").alias("shard"), (F.col("to") - F.col("k")).alias("from"), "to")


def shards_of(drawn: DataFrame, dealt: DataFrame) -> DataFrame:
    """The draws with the shard whose interval holds their index.

    Both sides are cut into stretches of indices; inside a stretch a draw takes the last interval that begins before it,
    so no draw meets more than one interval and no row carries the bounds of all shards.
    """
    whole = lambda c: F.floor(c / STRETCH).cast("bigint")
    begins = dealt.select("*", F.explode(F.sequence(whole(F.col("from")), whole(F.col("to") - 1))).alias("_stretch"))
    at = F.greatest(F.col("from"), F.col("_stretch") * STRETCH)
    begins = begins.select("source", "_stretch", at.alias("_index"), F.lit(0).alias("_side"), "shard")
    asks = drawn.withColumns({"_stretch": whole(F.col("_index")), "_side": F.lit(1)})
    order = Window.partitionBy("source", "_stretch").orderBy("_index", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = asks.unionByName(begins, allowMissingColumns=True)
    return both.withColumn("shard", F.last("shard", ignorenulls=True).over(order)).filter("_side = 1").drop("_stretch", "_side")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    budget_ratio: float = 1.5,
    max_repeats: int = 2,
    block_words: int = 256,
    shard_draws: int = 65536,
    seed: str = "mix",
) -> Mix:
    """Targets per source and the draws of every output shard, in order.

    Weights go to the sources in code point order and repeat. A shard holds
    about ``shard_draws`` blocks, so the number of shards follows the data.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(NON_SPACES)), F.lit(0)).cast("bigint")
    # rows without id are spread by their texts; the group is part of their number
    spread = F.when(F.col(id_col).isNull(), F.pmod(F.xxhash64(text_col), F.lit(RANGES))).otherwise(F.lit(0))
    sizes = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), spread.alias("_spread"))
    numbered = F.row_number().over(Window.partitionBy("_id", "_spread").orderBy("source", "size"))
    sizes = stage(sizes.withColumn("_row", numbered * RANGES + F.col("_spread")).drop("_spread"), "sizes")
    goal = stage(targets(sizes, weights, budget_ratio, max_repeats), "targets")
    known = join_same(sizes, goal, ["source"])

    block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("size") - 1) / block_words)))
    blocks = known.filter("size > 0").select("*", block.alias("_block"))
    blocks = blocks.withColumns(
        {
            "_start": F.col("_block") * block_words,
            "_words": F.least(F.lit(block_words).cast("bigint"), F.col("size") - F.col("_block") * block_words),
            "_h": F.xxhash64(F.lit(seed), "source", "_id", "_row", "_block"),
        }
    ).withColumn("_range", F.pmod(F.shiftright("_h", 40), F.lit(RANGES)))
    per_range = blocks.groupBy("source", "_range").agg(F.sum("_words").alias("_w"), F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        "source",
        "_range",
        F.coalesce(F.sum("_w").over(upto), F.lit(0)).alias("_w0"),
        F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_n0"),
        F.sum("_n").over(Window.partitionBy("source")).alias("_blocks"),
    )
    inside = Window.partitionBy("source", "_range").orderBy("_h", "_id", "_row", "_block").rowsBetween(Window.unboundedPreceding, -1)
    placed = join_same(blocks, offsets, ["source", "_range"])
    placed = placed.select(
        "_id", "_row", "source", "_block", "_start", "_words", "_blocks",
        F.round("target").cast("bigint").alias("_take"),
        "source_size",
        (F.col("_w0") + F.coalesce(F.sum("_words").over(inside), F.lit(0))).alias("_w0"),
        (F.col("_n0") + F.coalesce(F.count(F.lit(1)).over(inside), F.lit(0))).alias("_n0"),
    )
    passes = F.floor(F.col("_take") / F.col("source_size"))
    part = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("_words"), F.col("_take") - passes * F.col("source_size") - F.col("_w0")))
    epoch = F.explode(F.sequence(F.lit(0).cast("bigint"), passes))
    drawn = placed.select("*", part.alias("_part"), passes.alias("_passes"), epoch.alias("epoch"))
    drawn = drawn.withColumn("n_words", F.when(F.col("epoch") < F.col("_passes"), F.col("_words")).otherwise(F.col("_part")))
    drawn = drawn.filter("n_words > 0").select(
        "_id", "_row", "source", "epoch", F.col("_start").alias("start_word"), "n_words",
        (F.col("epoch") * F.col("_blocks") + F.col("_n0")).alias("_index"),
    )
    drawn = stage(drawn, "draws")

    counts = stage(drawn.groupBy("source").agg(F.count(F.lit(1)).alias("_draws")), "draw-counts")
    total = counts.agg(F.sum("_draws")).first()[0] or 0
    n_shards = power_of_two(-(-total // shard_draws)) if total else 1
    # written first: a tree of many levels would be computed again by every reader
    dealt = shards_of(drawn, stage(quotas(counts, n_shards, total, seed), "quotas"))
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "source", "_index"), "source", "_index")
    draws = dealt.withColumn("position", F.row_number().over(order)).select(
        "shard", "position", F.col("_id").alias(id_col), "_row", "source", "epoch", "start_word", "n_words"
    )
    documents = known.select(F.col("_id").alias(id_col), "_row", "source", "size", "source_size", "target")
    return Mix(documents, stage(draws, "shards"))


def taken(mix: Mix, id_col: str = "doc_id") -> DataFrame:
    """The documents with the words the mix takes from each, the draws and shards these come in, and a digest of their places."""
    place = F.format_string("%d:%d", "shard", "position")
    words = mix.draws.groupBy(id_col, "_row").agg(
        F.sum("n_words").alias("taken"),
        F.count(F.lit(1)).alias("n_draws"),
        F.count_distinct("shard").alias("n_shards"),
        # a document has at most max_repeats draws for every block of its own text
        F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(place))), 256).alias("places_sha256"),
    )
    zero = F.lit(0).cast("bigint")
    out = join_same(mix.documents, words, [id_col, "_row"], "left")
    return out.withColumns({c: F.coalesce(c, zero) for c in ("taken", "n_draws", "n_shards")})
