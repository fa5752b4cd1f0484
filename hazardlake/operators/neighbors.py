"""Nearest-neighbour (max-norm) estimators of entropy, information and divergence.

Points ``(g, id, v array<double>)``: ``g`` names an independent estimation
problem, such as a feature.  Each problem is cut into tiles of about ``TILE``
points (by values of the first axis, then of the second inside each strip).  A query first meets its home tile, which bounds its radius, and then
only the tiles that its ball touches, so no task compares a whole problem with
itself and the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardlake.functions.ordered import count_at_most, hash_int
from hazardlake.session import materialize

TILE = 4096
NOISE = 1e-10  # breaks ties, as is usual for these estimators
_SUB = 1 << 31  # most tiles of one strip
_OVER = 4  # candidates per edge
_BLOCK = 64  # queries, neighbours on the first axis, that are compared with one slab of points


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-norm distances, axis by axis."""
    out = np.abs(a[:, 0, None] - b[None, :, 0])
    for i in range(1, a.shape[1]):
        np.maximum(out, np.abs(a[:, i, None] - b[None, :, i]), out=out)
    return out


def _slab(first: np.ndarray, q: np.ndarray, r: np.ndarray) -> tuple[int, int]:
    """Range of points, sorted by first axis, that can lie within r of any of the queries; a little wider, as sums are rounded.

    All points where a query or radius is not a number.
    """
    x = q[:, 0]
    if np.isnan(x).any() or np.isnan(r).any():
        return 0, len(first)
    slack = (np.abs(x) + np.abs(r)) * 1e-14
    return int(np.searchsorted(first, (x - r - slack).min())), int(np.searchsorted(first, (x + r + slack).max(), "right"))


def nearest_distances(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Per row of ``a`` the ascending distances to its k nearest rows of ``b`` (to all if there are fewer).

    Points near a block of queries on the first axis bound its radii; only the slab within these is searched.
    """
    order, b = np.argsort(a[:, 0], kind="stable"), b[np.argsort(b[:, 0], kind="stable")]
    take = min(k, len(b))
    out, first = np.empty((len(a), take)), b[:, 0].copy()
    for s in range(0, len(a), _BLOCK):
        q = a[order[s : s + _BLOCK]]
        lo = max(0, int(np.searchsorted(first, q[0, 0])) - 4 * take)
        hi = min(len(b), int(np.searchsorted(first, q[-1, 0], "right")) + 4 * take)
        d = _distances(q, b[lo:hi])
        low, high = _slab(first, q, np.partition(d, take - 1, axis=1)[:, take - 1])
        if low < lo or high > hi:
            d = _distances(q, b[min(low, lo) : max(high, hi)])
        out[order[s : s + _BLOCK]] = np.sort(np.partition(d, take - 1, axis=1)[:, :take], axis=1)
    return out


def counts_within(a: np.ndarray, r: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per row of ``a`` how many rows of ``b`` lie within its radius."""
    order, b = np.argsort(a[:, 0], kind="stable"), b[np.argsort(b[:, 0], kind="stable")]
    out, first = np.empty(len(a), dtype=np.int64), b[:, 0].copy()
    for s in range(0, len(a), _BLOCK):
        at = order[s : s + _BLOCK]
        low, high = _slab(first, a[at], r[at])
        out[at] = (_distances(a[at], b[low:high]) <= r[at, None]).sum(axis=1)
    return out


def jitter(value: Column, id_col: str, axis: int) -> Column:
    """The value plus a tiny amount fixed by row and axis."""
    text = F.concat(F.lit(f"{axis}:"), F.col(id_col).cast("string"))
    return value + F.lit(NOISE) * (hash_int(text).cast("double") / F.lit(float(16**15)))


def digamma_int(n: Column) -> Column:
    """psi(n) for positive whole numbers: harmonic sum, or its expansion from 20 on."""
    small, h = [], -0.57721566490153286061
    for i in range(1, 20):
        small.append(F.lit(h))
        h += 1.0 / i
    x = n.cast("double")
    y = 1.0 / (x * x)
    big = F.log(x) - 0.5 / x - y * (1 / 12.0 - y * (1 / 120.0 - y / 252.0))
    return F.when(n < 20, F.get(F.array(*small), n.cast("int") - 1)).otherwise(big)


class Tiles:
    """Points cut into tiles of about ``tile`` points; edges, boxes and counts of tiles are tables.

    Edges are every fourth of a hash-chosen part of a problem's own values, so a problem may have any number of tiles.
    """

    def __init__(self, points: DataFrame, tile: int = TILE):
        biggest = points.groupBy("g").count().agg(F.max("count")).first()[0] or 0
        self.dim = points.select(F.size("v")).first()[0] if biggest else 1
        strips = max(1, -(-biggest // tile))
        strip = tile if self.dim == 1 else max(tile, biggest // math.ceil(math.sqrt(strips)))
        self.e1 = self._edges(points.select("g", "id", F.get("v", F.lit(0)).alias("a")), ["g"], strip)
        placed = self._strip(points)
        second = placed.select("g", "_s", "id", F.get("v", F.lit(1)).alias("a"))
        self.e2 = self._edges(second, ["g", "_s"], tile) if self.dim > 1 else None
        self.points = materialize(self.place(points))
        ends = [F.array(*[f(F.get("v", F.lit(i))) for i in range(self.dim)]).alias(n) for n, f in (("lo", F.min), ("hi", F.max))]
        boxes = materialize(self.points.groupBy("g", "tile").agg(F.count(F.lit(1)).alias("n"), *ends))
        boxes = boxes.withColumn("_s", F.floor(F.col("tile") / _SUB))
        # a strip of two or more axes has about as many tiles as there are strips, a strip of one axis has one
        self.boxes = materialize(boxes.groupBy("g", "_s").agg(F.collect_list(F.struct("tile", "n", "lo", "hi")).alias("tiles")))
        self.counts = None
        if self.dim == 1:  # points up to every strip; only the first strip can be empty
            upto = F.sum("n").over(Window.partitionBy("g").orderBy("_s"))
            listed = boxes.select("g", "_s", upto.alias("u")).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("_s", "u"))).alias("c"))
            from_zero = F.when(F.get("c", F.lit(0))["_s"] == 0, F.col("c.u")).otherwise(F.array_prepend("c.u", F.lit(0).cast("bigint")))
            self.counts = materialize(listed.select("g", from_zero.alias("_c")))

    @staticmethod
    def _edges(values: DataFrame, keys: list[str], size: int) -> DataFrame:
        part = F.pmod(F.xxhash64("id", F.lit(len(keys))), F.lit(max(1, size // _OVER))) == 0
        listed = values.filter(part).groupBy(*keys).agg(F.sort_array(F.collect_list("a")).alias("_e"))
        return materialize(listed.withColumn("_e", F.array_distinct(F.filter("_e", lambda _, i: i % _OVER == _OVER - 1))))

    def _strip(self, df: DataFrame) -> DataFrame:
        at = F.coalesce(count_at_most(F.col("_e"), F.get("v", F.lit(0))), F.lit(0)).cast("bigint")
        return df.join(self.e1, "g", "left").withColumn("_s", at).drop("_e")

    def place(self, df: DataFrame) -> DataFrame:
        df = self._strip(df)
        if self.e2 is None:
            return df.withColumn("tile", F.col("_s") * _SUB).drop("_s")
        sub = F.coalesce(count_at_most(F.col("_e"), F.get("v", F.lit(1))), F.lit(0))
        return df.join(self.e2, ["g", "_s"], "left").withColumn("tile", F.col("_s") * _SUB + sub).drop("_s", "_e")

    def _meet(self, queries: DataFrame, fn, schema: str) -> DataFrame:
        """Queries and points of equal tile, heavy tiles in several portions."""
        heavy = queries.groupBy("g", "tile").agg(F.ceil(F.count(F.lit(1)) / (8.0 * TILE)).cast("int").alias("_n"))
        q = queries.join(heavy, ["g", "tile"]).withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int")).drop("_n")
        p = self.points.join(heavy, ["g", "tile"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
        p = p.select(*[F.col(c).alias(c) for c in p.columns])  # own column ids: both sides may share a source
        keys = ["g", "tile", "_part"]
        return q.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInPandas(fn, schema)

    def _touched(self, queries: DataFrame, whole: bool) -> DataFrame:
        """(query, to) for tiles its ball touches; with ``whole``, tiles inside it only add their size in rows with to = -1.

        Edges tell the strips (a little more than the ball, as sums are rounded); boxes of a strip tell its tiles.
        """
        first_axis, r = F.get("v", F.lit(0)), F.col("r")
        slack = (F.abs(first_axis) + r) * 1e-14
        strip = lambda x: F.coalesce(count_at_most(F.col("_e"), x), F.lit(0)).cast("bigint")
        q = queries.select("g", "id", "tile", "v", "r").join(self.e1, "g", "left")
        q = q.withColumns({"_a": strip(first_axis - r - slack), "_b": strip(first_axis + r + slack)})
        strips, columns = F.sequence("_a", "_b"), ["g", "id", "tile", "v", "r"]
        counted = None
        if whole and self.dim == 1:
            # strips between these two lie inside the ball
            q = q.withColumns({"_in": strip(first_axis - r + slack), "_out": strip(first_axis + r - slack)})
            between = F.col("_out") > F.col("_in") + 1
            n = F.get("_c", (F.col("_out") - 1).cast("int")) - F.get("_c", F.col("_in").cast("int"))
            counted = q.filter(between).join(self.counts, "g").select(*columns, F.lit(-1).cast("bigint").alias("to"), n.alias("full"))
            strips = F.when(between, F.concat(F.sequence("_a", "_in"), F.sequence("_out", "_b"))).otherwise(strips)
        met = q.select(*columns, F.explode(strips).alias("_s")).join(self.boxes, ["g", "_s"])

        def reach(box, far):
            """Largest distance over the axes: to the far side of the box, or to the near one."""
            sides = []
            for i in range(self.dim):
                lo, hi, x = F.get(box["lo"], F.lit(i)), F.get(box["hi"], F.lit(i)), F.get("v", F.lit(i))
                sides += [hi - x, x - lo] if far else [lo - x, x - hi]
            return F.greatest(*sides)

        touched = F.filter("tiles", lambda t: reach(t, False) <= r)
        if not whole:
            return met.select(*columns, F.explode(F.transform(touched, lambda t: t["tile"])).alias("to"))
        met = met.withColumn("tiles", touched)
        inside = lambda t: reach(t, True) <= r
        n = F.aggregate("tiles", F.lit(0).cast("bigint"), lambda acc, t: acc + F.when(inside(t), t["n"]).otherwise(0))
        edge = F.transform(F.filter("tiles", lambda t: ~inside(t)), lambda t: F.struct(t["tile"].alias("to"), F.lit(0).cast("bigint").alias("full")))
        rows = F.array_append(edge, F.struct(F.lit(-1).cast("bigint").alias("to"), n.alias("full")))
        out = met.select(*columns, F.explode(rows).alias("_t")).select(*columns, "_t.to", "_t.full")
        return out if counted is None else out.unionByName(counted)

    def kth_distance(self, queries: DataFrame, k: int) -> DataFrame:
        """``(g, id, v, r)``: distance to the k-th nearest point (a query's own point counts)."""
        dtypes = dict(queries.dtypes)
        schema = f"g {dtypes['g']}, id {dtypes['id']}, tile bigint, v array<double>, near array<double>"

        def nearest(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
            if not len(q):
                return pd.DataFrame({"g": [], "id": [], "tile": [], "v": [], "near": []})
            near = [np.zeros(0)] * len(q)
            if len(p):
                near = list(nearest_distances(np.stack(q["v"].to_numpy()), np.stack(p["v"].to_numpy()), k))
            return q[["g", "id", "tile", "v"]].assign(near=near)

        home = materialize(self._meet(self.place(queries), nearest, schema))
        radius = F.when(F.size("near") >= k, F.get("near", F.lit(k - 1))).otherwise(F.lit(float("inf")))
        others = self._touched(home.select("g", "id", "tile", "v", radius.alias("r")), False).filter("to <> tile")
        far = self._meet(others.select("g", "id", F.col("to").alias("tile"), "v"), nearest, schema)
        near = home.unionByName(far).groupBy("g", "id").agg(F.sort_array(F.flatten(F.collect_list("near"))).alias("near"), F.first("v").alias("v"))
        return near.select("g", "id", "v", F.get("near", F.lit(k - 1)).alias("r"))

    def count_within(self, queries: DataFrame) -> DataFrame:
        """``(g, id, n)``: points at distance <= r from each query ``(g, id, v, r)``."""
        dtypes = dict(queries.dtypes)
        schema = f"g {dtypes['g']}, id {dtypes['id']}, n bigint"

        def count(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(p):
                return pd.DataFrame({"g": [], "id": [], "n": []})
            return q[["g", "id"]].assign(n=counts_within(np.stack(q["v"].to_numpy()), q["r"].to_numpy(), np.stack(p["v"].to_numpy())))

        touched = materialize(self._touched(queries.withColumn("tile", F.lit(0).cast("bigint")), True))
        inside = touched.filter("to = -1").select("g", "id", F.col("full").alias("n"))
        edge = self._meet(touched.filter("to >= 0").select("g", "id", F.col("to").alias("tile"), "v", "r"), count, schema)
        return inside.unionByName(edge).groupBy("g", "id").agg(F.sum("n").alias("n"))


def _sub(points: DataFrame, axes: Sequence[int]) -> DataFrame:
    return points.withColumn("v", F.array(*[F.get("v", F.lit(a)) for a in axes]))


def jittered(points: DataFrame) -> DataFrame:
    dim = points.select(F.size("v")).first()[0]
    return points.withColumn("v", F.array(*[jitter(F.get("v", F.lit(a)), "id", a) for a in range(dim)]))


def knn_entropy(points: DataFrame, k: int = 3, base: float = 2.0, tile: int = TILE) -> DataFrame:
    """Kozachenko-Leonenko entropy per ``g``; problems of at most k points give NULL."""
    pts = materialize(jittered(points))
    t = Tiles(pts, tile)
    r = t.kth_distance(pts.select("g", "id", "v"), k + 1)
    s = r.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg(F.log("r")).alias("m"))
    ent = (digamma_int(F.col("n")) - digamma_int(F.lit(k)) + t.dim * math.log(2.0) + t.dim * F.col("m")) / math.log(base)
    return s.select("g", "n", F.when(F.col("n") > k, ent).alias("entropy"))


def _mean_digamma(points: DataFrame, radii: DataFrame, axes: Sequence[int], tile: int, name: str) -> DataFrame:
    """Mean psi of the number of points closer than the joint radius in a subspace."""
    sub = materialize(_sub(points, axes))
    q = _sub(radii, axes).select("g", "id", "v", (F.col("r") - 1e-15).alias("r"))
    n = Tiles(sub, tile).count_within(q)
    return n.groupBy("g").agg(F.avg(digamma_int(F.col("n"))).alias(name))


def ksg_mi(points: DataFrame, k: int = 3, base: float = 2.0, tile: int = TILE) -> DataFrame:
    """Kraskov mutual information of the two axes of ``v``."""
    pts = materialize(jittered(points))
    r = materialize(Tiles(pts, tile).kth_distance(pts.select("g", "id", "v"), k + 1))
    a, b = _mean_digamma(pts, r, [0], tile, "a"), _mean_digamma(pts, r, [1], tile, "b")
    n = pts.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    mi = (-F.col("a") - F.col("b") + digamma_int(F.lit(k)) + digamma_int(F.col("n"))) / math.log(base)
    return n.join(a, "g").join(b, "g").select("g", mi.alias("mi"))


def ksg_cmi(points: DataFrame, k: int = 3, base: float = 2.0, tile: int = TILE) -> DataFrame:
    """Kraskov information of axes 0 and 1 given axis 2."""
    pts = materialize(jittered(points))
    r = materialize(Tiles(pts, tile).kth_distance(pts.select("g", "id", "v"), k + 1))
    a = _mean_digamma(pts, r, [0, 2], tile, "a")
    b = _mean_digamma(pts, r, [1, 2], tile, "b")
    c = _mean_digamma(pts, r, [2], tile, "c")
    cmi = (-F.col("a") - F.col("b") + F.col("c") + digamma_int(F.lit(k))) / math.log(base)
    return a.join(b, "g").join(c, "g").select("g", cmi.alias("cmi"))


def knn_kl_divergence(p: DataFrame, q: DataFrame, k: int = 3, base: float = 2.0, tile: int = TILE) -> DataFrame:
    """KL(p || q) per ``g`` from a sample of each.

    Points are jittered as for the other estimators, so repeated points have
    small distances instead of none.
    """
    p, q = (materialize(jittered(d.select("g", "id", "v"))) for d in (p, q))
    tp = Tiles(p, tile)
    own = tp.kth_distance(p, k + 1).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg(F.log("r")).alias("a"))
    cross = Tiles(q, tile).kth_distance(p, k).groupBy("g").agg(F.avg(F.log("r")).alias("b"))
    m = q.groupBy("g").agg(F.count(F.lit(1)).alias("m"))
    kl = (F.log("m") - F.log(F.col("n") - 1) + tp.dim * F.col("b") - tp.dim * F.col("a")) / math.log(base)
    return own.join(cross, "g").join(m, "g").select("g", kl.alias("kl"))


def mixed_mi(points: DataFrame, label: str = "label", k: int = 3, base: float = 2.0, tile: int = TILE) -> DataFrame:
    """Continuous x against a discrete label: H(x) - sum p(y) H(x|y).

    A class of at most k points counts with the overall entropy.
    """
    plain = points.select("g", "id", "v")
    whole = materialize(knn_entropy(plain, k, base, tile))
    # JSON quotes its texts, so two pairs never share a key
    pair = F.to_json(F.struct("g", F.col(label).alias("y")))
    names = points.withColumn("g", pair).select("g", "id", "v")
    keys = points.select(pair.alias("key"), "g").distinct()
    given = knn_entropy(names, k, base, tile).withColumnRenamed("g", "key").join(keys, "key")
    given = given.select("g", F.col("n").alias("ny"), F.col("entropy").alias("hy"))
    j = given.join(whole, "g")
    part = F.sum(F.col("ny") / F.col("n") * F.coalesce("hy", "entropy"))
    return j.groupBy("g").agg((F.max("entropy") - part).alias("mi"))
