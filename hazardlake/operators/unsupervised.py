"""Screening without the target: variance and pairwise correlation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlake.functions import blocks
from hazardlake.operators.preprocess import MAX_BROADCAST_FEATURES
from hazardlake.session import materialize


def low_variance(long: DataFrame, threshold: float = 0.05, keys: Sequence[str] = ()) -> DataFrame:
    """Population variance per feature and whether it exceeds the threshold.

    At threshold 0 the smaller of variance and range decides, so that rounding
    cannot keep a constant column.
    """
    s = long.groupBy(*keys, "feature").agg(
        F.var_pop("value").alias("variance"), (F.max("value") - F.min("value")).alias("_range")
    )
    shown = F.least("variance", "_range") if threshold == 0 else F.col("variance")
    return s.select(*keys, "feature", shown.alias("variance"), F.coalesce(shown > threshold, F.lit(False)).alias("kept"))


def pearson_pairs(
    vectors: DataFrame,
    features: Sequence[str],
    x: str = "x",
    threshold: float | None = None,
    absolute: bool = False,
    index: Sequence[int] | None = None,
    block: int = blocks.BLOCK,
) -> DataFrame:
    """``(i, j, f1, f2, r, n)`` for feature pairs i > j, nulls left out pairwise.

    ``vectors`` holds one array column; ``index`` names the places of ``features`` in it, all in
    order by default. Constant or never jointly present pairs give NULL. With a ``threshold``
    only pairs that reach it (signed, or ``absolute``) leave their block, so a screening
    of tens of thousands of columns returns its edges, not p x p rows.
    """
    at = np.arange(len(features)) if index is None else np.asarray(index, dtype=np.int64)
    center = blocks.column_means(vectors, x, at)
    partial = blocks.block_products(vectors, x, at, center, block)
    return blocks.finish(partial, blocks.pair_rows(features, block, threshold, absolute), "i int, j int, f1 string, f2 string, r double, n long")


def correlated_edges(pairs: DataFrame, threshold: float = 0.8, absolute: bool = False) -> DataFrame:
    r = F.abs("r") if absolute else F.col("r")
    return pairs.filter(r >= threshold).select("i", "j", "f1", "f2", "r")


def drop_correlated(edges: DataFrame, n_features: int, block: int = blocks.BLOCK) -> DataFrame:
    """``(pos, kept)``: feature i goes when an earlier kept feature j has an edge to it.

    The sweep takes the features in blocks. What a block loses to kept features of
    earlier blocks is one aggregate; only the edges inside the block, bounded by its
    size, are swept in order here. One flag per feature is all that is kept.
    """
    spark = edges.sparkSession
    cell = lambda c: F.floor(F.col(c) / block).cast("int")
    placed = edges.select("i", "j", cell("i").alias("bi"), cell("j").alias("bj"))
    n_blocks = -(-n_features // block)
    if n_blocks > 1:  # a block reads its own edges only
        placed = materialize(placed.repartition("bi").sortWithinPartitions("bi"))
    kept = np.ones(n_features, dtype=bool)
    for b in range(n_blocks):
        mine, lo = placed.filter(F.col("bi") == b), b * block
        gone = np.zeros(min(block, n_features - lo), dtype=bool)
        if b:
            flags = spark.createDataFrame([(int(k),) for k in np.flatnonzero(kept[:lo])], "j int")
            lost = mine.filter(F.col("bj") < b).join(flags, "j", "left_semi").select("i").distinct()
            for r in lost.collect():  # at most one row per feature of the block
                gone[r["i"] - lo] = True
        inside = mine.filter(F.col("bj") == b).select("i", "j").toPandas().sort_values(["i", "j"])  # at most block * block / 2 rows
        for i, j in inside.to_numpy() - lo:
            if not gone[j]:
                gone[i] = True
        kept[lo : lo + len(gone)] = ~gone
    return spark.createDataFrame([(i, bool(k)) for i, k in enumerate(kept)], "pos int, kept boolean")


def correlation_groups(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """``(group, member)``: a kept feature with the later features it removed.

    A removed feature belongs to every kept earlier neighbour's group.  The
    group is named after its alphabetically first member, or after its kept
    feature where several groups have the same first member.
    """
    heads = kept.filter("kept").select(F.col("pos").alias("j"))
    gone = kept.filter(~F.col("kept")).select(F.col("pos").alias("i"))
    members = edges.join(heads, "j").join(gone, "i").select("j", F.col("f1").alias("head"), F.col("f2").alias("member"))
    everyone = members.select("j", "member").unionByName(members.select("j", F.col("head").alias("member")).distinct())
    names = everyone.groupBy("j").agg(F.min("member").alias("first")).join(members.select("j", "head").distinct(), "j")
    shared = names.groupBy("first").agg(F.count(F.lit(1)).alias("times"))
    name = F.concat(F.lit("group_"), F.when(F.col("times") > 1, F.col("head")).otherwise(F.col("first")))
    names = names.join(shared, "first").select("j", name.alias("group"))
    return everyone.join(names, "j").select("group", "member")


def apply_groups(long: DataFrame, groups: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """Replace grouped features by their row mean, keep the others.

    ``groups`` was fitted on training rows; the same mapping serves any split.
    """
    # a few rows per feature: sent to every task, so that no task takes a feature's whole column
    g = materialize(groups.withColumnRenamed("member", "feature"))
    if g.limit(MAX_BROADCAST_FEATURES + 1).count() <= MAX_BROADCAST_FEATURES:
        g = F.broadcast(g)
    means = (
        long.join(g, "feature").groupBy(*id_cols, "group").agg(F.avg("value").alias("value"))
        .withColumnRenamed("group", "feature")
    )
    rest = long.join(g.select("feature"), "feature", "left_anti")
    return rest.select(*id_cols, "feature", "value").unionByName(means.select(*id_cols, "feature", "value"))


def unsupervised_screen(
    vectors: DataFrame, long: DataFrame, features: Sequence[str], handle_correlated: str = "drop",
    variance_threshold: float | None = None, corr_threshold: float = 0.8, absolute: bool = False,
) -> tuple[list[str], DataFrame | None]:
    """Chained screening: kept features and, for ``group``, the group mapping."""
    if handle_correlated not in ("drop", "group", "ignore"):
        raise ValueError(f"unknown handling of correlated features: {handle_correlated}")
    keep = list(features)
    if variance_threshold is not None:
        ok = {r["feature"] for r in low_variance(long, variance_threshold).filter("kept").collect()}
        keep = [f for f in keep if f in ok]
    if handle_correlated == "ignore" or len(keep) < 2:
        return keep, None
    place = {f: i for i, f in enumerate(features)}
    found = pearson_pairs(vectors, keep, threshold=corr_threshold, absolute=absolute, index=[place[f] for f in keep])
    edges = materialize(found.select("i", "j", "f1", "f2", "r"))
    kept = drop_correlated(edges, len(keep))
    names = [keep[r["pos"]] for r in kept.filter("kept").orderBy("pos").collect()]
    if handle_correlated == "drop":
        return names, None
    groups = correlation_groups(edges, kept)
    grouped = {r["member"] for r in groups.select("member").distinct().collect()}
    named = [r["group"] for r in groups.select("group").distinct().orderBy("group").collect()]
    return [f for f in names if f not in grouped] + named, groups
