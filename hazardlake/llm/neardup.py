"""Near-duplicates: DartMinHash signatures, banded joining, exact verification.

Every element (shingle) owns a region of its weight times the time axis. Darts
fall into the region as a Poisson process drawn from hashes: unit cells of
weight, hashed waiting times, one hashed coordinate each. A document with total
weight W looks at times below t / W only, which yields about t darts whatever
its size; the earliest dart per coordinate is the signature, and a document in
which a coordinate stays empty looks twice as far. Two signatures agree on a
coordinate with probability equal to the weighted Jaccard similarity. With all
weights 1 that is the Jaccard similarity of the shingle sets.

Documents with equal words are one node. Sixteen bands of four coordinates make
bucket keys; a pair at similarity 0.8 shares none with probability 2e-4. Inside
a bucket nodes are linked to one hub, so a bucket with a third of all nodes
costs one pair per node; links count only if the exact similarity of the shingle
sets reaches the threshold. Connected components follow from the links. Then
other hubs are tried for buckets that hold several components, and at last all
pairs that still lie in one bucket but in different components are verified, so
no link between components that the bands propose is left out.

Cases: null or blank text has no shingles: such rows are classes of their own; a
text of fewer than five words is one shingle; rows that repeat id or text fall
into the class of their words; the class id is the smallest id (null last);
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardlake.llm.common import arrow_bytes, drop_rows, mix64, parallelism, pieces, power_of_two, small, stage
from hazardlake.llm.shingles import shingle_hashes, words_text

COORDINATES, ROWS = 64, 4
THRESHOLD = 0.8
PIECE = 1 << 20
#: Numbers of 64 bits that mark what a node and its hub do not share.
MARKS = 4


def unit(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def darts(element: np.ndarray, weight: np.ndarray | None, doc: np.ndarray, until: np.ndarray, k: int):
    """All darts before ``until[doc]``: document, coordinate, time, identity."""
    if weight is None:
        cell, h, top = np.zeros(len(element)), element, np.ones(len(element))
    else:
        n_cells = np.ceil(weight).astype(np.int64)
        top, doc = np.repeat(weight, n_cells), np.repeat(doc, n_cells)
        cell = np.arange(len(top)) - np.repeat(np.cumsum(n_cells) - n_cells, n_cells)
        h = mix64(np.repeat(element, n_cells) + cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        cell = cell.astype(float)
    time, found = np.zeros(len(h)), []
    while len(h):
        h = mix64(h + np.uint64(0x9E3779B97F4A7C15))
        time = time - np.log(unit(h))
        on = time < until[doc]
        h, time, doc, cell, top = h[on], time[on], doc[on], cell[on], top[on]
        spot = mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        hit = cell + unit(spot) < top
        found.append((doc[hit], (spot[hit] & np.uint64(0x7FF)).astype(np.int64) % k, time[hit], h[hit]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 4


def signatures(element: np.ndarray, counts: np.ndarray, weight: np.ndarray | None = None, k: int = COORDINATES) -> np.ndarray:
    """Identity of the earliest dart per coordinate, one row per document with elements."""
    n = len(counts)
    out, filled = np.zeros((n, k), np.uint64), np.zeros(n, bool)
    doc = np.repeat(np.arange(n), counts)
    mass = np.bincount(doc, weights=weight, minlength=n).astype(float)
    todo, look = np.nonzero(counts)[0], k * math.log(k) + 2 * k
    while len(todo):
        mine = np.isin(doc, todo) if len(todo) < n else slice(None)
        until = look / np.maximum(mass, 1e-300)
        d, c, t, name = darts(element[mine], None if weight is None else weight[mine], doc[mine], until, k)
        order = np.lexsort((t, d * k + c))
        place = (d * k + c)[order]
        first = np.ones(len(place), bool)
        first[1:] = place[1:] != place[:-1]
        place, name = place[first], name[order][first]
        out[place // k, place % k] = name
        filled[np.bincount(place // k, minlength=n) == k] = True
        todo, look = todo[~filled[todo]], look * 2
    return out


def weights_of(element: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements per document with their numbers of occurrences."""
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((element, doc))
    e, d = element[order], doc[order]
    new = np.ones(len(e), bool)
    new[1:] = (e[1:] != e[:-1]) | (d[1:] != d[:-1])
    at = np.nonzero(new)[0]
    return e[at], np.bincount(d[at], minlength=len(counts)), np.diff(np.append(at, len(e))).astype(float)


def node_of(text: Column) -> Column:
    """128 bits of the digest of the words."""
    return F.unhex(F.substring(F.sha2(words_text(text), 256), 1, 32))


def signed(docs: DataFrame, id_col: str, text_col: str, weighted: bool) -> DataFrame:
    """id, node and band keys of every row (no keys for a text without words)."""
    rows = docs.select(F.col(id_col).alias("id"), words_text(F.col(text_col)).alias("text"))
    rows = rows.withColumn("node", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    schema = T.StructType([rows.schema["id"], rows.schema["node"], T.StructField("bands", T.ArrayType(T.LongType()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix64(np.arange(1, COORDINATES // ROWS + 1).astype(np.uint64))
        for b in batches:
            raw, off = arrow_bytes(b.column("text"))
            keys, sizes = [], []
            for i, j in pieces(off, PIECE):
                element, counts = shingle_hashes(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                weight = None
                has = counts > 0
                if weighted:
                    element, counts, weight = weights_of(element, counts)
                sig = signatures(element, counts, weight)[has].reshape(-1, COORDINATES // ROWS, ROWS)
                key = np.broadcast_to(salt, sig.shape[:2]).copy()
                for r in range(ROWS):
                    key = mix64(key * np.uint64(31) + sig[:, :, r])
                keys.append(key.view(np.int64).ravel())
                sizes.append(np.where(has, COORDINATES // ROWS, 0))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1)
            bands = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("node"), bands], names=["id", "node", "bands"])

    return rows.mapInArrow(sign, schema)


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """node, items: sorted shingle hashes of the wanted nodes. ``wanted`` has one (node, id) per node."""
    named = small(wanted.select("node", F.col("id").alias("_wid")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(named, F.col("id").eqNullSafe(F.col("_wid")))
    # an id may stand on several texts
    rows = rows.select("node", words_text(F.col("text")).alias("text")).filter(F.unhex(F.substring(F.sha2("text", 256), 1, 32)) == F.col("node"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = arrow_bytes(b.column("text"))
            for i, j in pieces(off, PIECE):
                element, counts, _ = weights_of(*shingle_hashes(raw[off[i] : off[j]], off[i : j + 1] - off[i]))
                at = np.concatenate([[0], np.cumsum(counts)])
                items = [element[at[k] : at[k + 1]].tobytes() for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([b.column("node").slice(i, j - i), pa.array(items, pa.binary())], names=["node", "items"])

    return rows.mapInArrow(sets, "node binary, items binary").groupBy("node").agg(F.first("items").alias("items"))


def marks(elements: np.ndarray) -> np.ndarray:
    """Bits of hashed elements, as signed numbers."""
    out = np.zeros(MARKS, np.uint64)
    place = elements & np.uint64(64 * MARKS - 1)
    np.bitwise_or.at(out, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return out.view(np.int64)


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the sizes of their shingle sets and of the intersection.

    m0.. mark the shingles of b that a lacks, p0.. those of a that b lacks.
    """
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    names = [*[f"m{i}" for i in range(MARKS)], *[f"p{i}" for i in range(MARKS)]]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("x"), b.column("y")
            out, bits = np.zeros((b.num_rows, 3), np.int32), np.zeros((b.num_rows, 2 * MARKS), np.int64)
            for i in range(b.num_rows):
                p, q = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                same = q[at] == p
                out[i] = same.sum(), len(p), len(q)
                gone = np.ones(len(q), bool)
                gone[at[same]] = False
                bits[i, :MARKS], bits[i, MARKS:] = marks(q[gone]), marks(p[~same])
            cols = [*[pa.array(out[:, k]) for k in range(3)], *[pa.array(bits[:, k]) for k in range(2 * MARKS)]]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), *cols], names=["a", "b", "both", "n_a", "n_b", *names])

    met = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return met.mapInArrow(check, "a binary, b binary, both int, n_a int, n_b int, " + ", ".join(f"{c} long" for c in names))


def bits_set(*numbers: Column) -> Column:
    return functools.reduce(lambda a, b: a + b, [F.bit_count(n) for n in numbers])


def most_shared(x: str, y: str) -> Column:
    """No two nodes compared with one hub share more shingles than this."""
    col = lambda side, c: F.col(f"{side}{c}")
    lost = bits_set(*[col(x, f"m{i}").bitwiseOR(col(y, f"m{i}")) for i in range(MARKS)])
    own = lambda a, b: col(a, "size") - col(a, "both") - bits_set(*[col(a, f"p{i}").bitwiseAND(F.bitwise_not(col(b, f"p{i}"))) for i in range(MARKS)])
    # of the hub's shingles at most what neither lacks; of the others at most those that are not one's own for sure
    hub_part = F.least(col(x, "both"), col(y, "both"), col(x, "hub_size") - lost)
    return hub_part + F.least(own(x, y), own(y, x))


def linked(pairs: DataFrame, threshold: float) -> DataFrame:
    return pairs.filter(F.col("both") >= threshold * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of every connected component, by hooking and pointer jumping."""
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    both = stage(both, "links")
    labels = stage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("heard"))
        new = labels.join(heard, F.col("node") == F.col("a")).select("node", "label", F.least("label", "heard").alias("next"))
        new = stage(new, "heard")
        # a label's own label, which is at most the label itself
        up = new.select(F.col("node").alias("_n"), F.col("next").alias("_up"))
        done = stage(new.join(up, F.col("next") == F.col("_n"), "left").select("node", F.col("label").alias("was"), F.least("next", "_up").alias("label")), "labels")
        if done.filter("was <> label").isEmpty():
            return done.select("node", "label")
        labels = done.select("node", "label")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, weighted: bool = False) -> DataFrame:
    """One row per input row: id, class_id, class_size, kept.

    ``weighted`` makes signatures count repeated shingles; links are always
    verified on the sets.
    """
    rows = stage(signed(docs, id_col, text_col, weighted), "signatures")
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("node").alias("node"))
    nodes = rows.filter(F.size("bands") > 0).groupBy("node").agg(F.first("bands").alias("bands"), F.min(first).alias("first"))
    nodes = stage(nodes, "nodes")
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    member = stage(keyed.join(sizes, "key"), "members")
    weight = member.groupBy("node").agg(F.sum("n").alias("weight"))
    member = member.select("key", "node").join(weight, "node")
    hubs = member.groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("hub"))
    member = stage(member.select("key", "node").join(hubs, "key"), "buckets")

    some = member.select("node").distinct()
    sets = stage(shingle_sets(docs, id_col, text_col, nodes.join(some, "node").select("node", F.col("first.id").alias("id"))), "shingle-sets")
    pairs = member.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    near = stage(compared(pairs, sets), "compared")
    edges = linked(near, threshold)
    labels = components(edges)

    # nodes that did not join their hub's component, against the rest of their buckets
    placed = member.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    top = placed.filter("node = hub").select("key", F.col("label").alias("hub_label"))
    placed = placed.join(top, "key")
    with_outs = placed.groupBy("key").agg(F.sum((F.col("label") != F.col("hub_label")).cast("int")).alias("outs"), F.count(F.lit(1)).alias("n")).filter("outs > 0 AND n > 2")
    placed = placed.join(with_outs.select("key"), "key").filter("node <> hub")
    bits = [f"{c}{i}" for c in "mp" for i in range(MARKS)]
    told = near.select(F.col("a").alias("node"), F.col("b").alias("hub"), "both", F.col("n_a").alias("size"), F.col("n_b").alias("hub_size"), *bits)
    placed = stage(placed.join(told, ["node", "hub"]), "open-buckets")
    if not placed.isEmpty():
        cols = ("node", "label", "both", "size", "hub_size", *bits)
        x = placed.filter("label <> hub_label").select("key", *[F.col(c).alias(f"x_{c}") for c in cols])
        y = placed.select("key", "hub_label", *[F.col(c).alias(f"y_{c}") for c in cols])
        once = (F.col("y_label") == F.col("hub_label")) | (F.col("x_node") > F.col("y_node"))
        may = (1 + threshold) * most_shared("x_", "y_") >= threshold * (F.col("x_size") + F.col("y_size")) - 1e-9
        met = x.join(y, (x["key"] == y["key"]) & (F.col("x_label") != F.col("y_label")) & once & may)
        pairs = met.select(F.greatest("x_node", "y_node").alias("a"), F.least("x_node", "y_node").alias("b")).distinct()
        done = near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        more = stage(linked(compared(pairs.join(done, ["a", "b"], "left_anti"), sets), threshold), "edges")
        if not more.isEmpty():
            labels = components(edges.union(more))

    # down to the rows over runs of rows, so a class with a third of them stays spread
    n_runs = power_of_two(parallelism(docs.sparkSession))
    named = nodes.select("node", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = rows.withColumn("run", F.pmod(F.xxhash64("id"), F.lit(n_runs)))
    leaves = rows.filter(F.size("bands") > 0).groupBy("run", "node").agg(F.count(F.lit(1)).alias("n"))
    leaves = stage(leaves.join(named, "node"), "class-leaves")
    classes = leaves.groupBy("label").agg(F.min("first").alias("top"), F.sum("n").alias("class_size"))
    answers = leaves.select("run", "node", "label").join(classes, "label").select("run", "node", "top", "class_size")
    out = rows.select("id", "run", "node").join(answers, ["run", "node"], "left").withColumns(
        {"top": F.coalesce("top", first), "class_size": F.coalesce("class_size", F.lit(1).cast("bigint")), "single": F.col("class_size").isNull()}
    )
    again = F.row_number().over(Window.partitionBy("run", "node", "id").orderBy(F.lit(0)))
    own = F.col("id").eqNullSafe(F.col("top.id")) & (F.col("node") == F.col("top.node"))
    return out.withColumn("again", again).select(
        F.col("id").alias(id_col),
        F.col("top.id").alias("class_id"),
        "class_size",
        (F.col("single") | (own & (F.col("again") == 1))).alias("kept"),
        F.lower(F.hex("node")).alias("words_hash"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns."""
    found = stage(near_duplicates(docs, id_col, text_col), "classes").withColumn("_kn", F.unhex("words_hash"))
    return drop_rows(docs, found, id_col, node_of(F.col(text_col)))
