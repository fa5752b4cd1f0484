"""One Cox model per feature, for tens of thousands of features at once.

State is keyed by (block of features, range of times). Rows are dealt once: every row
goes to each block with its slice of the features, inside a block to its time range,
and lies there in descending time. Ranges come from the counts of distinct times and follow the
number of slots, not of rows; a time with more rows than a range is a range of its own and
is dealt to several tasks.

A Newton step reads the slices twice. The first pass adds up e^eta, x e^eta and
x^2 e^eta per range; what lies in later ranges is then known for each of them. The second
runs down the times of a range, from that offset on, and gives log-likelihood, gradient
and curvature per feature. A task holds vectors as long as a block; the driver one
number per feature, and one per feature and range. With a single range the first pass is left out.

Risk sets are kept relative to their largest eta, so no linear predictor is clipped.
Ties are Breslow's. A missing value takes its row out of that feature's model only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlake.functions.blocks import column_means
from hazardlake.functions.gram import sum_vectors, to_numpy
from hazardlake.functions.ordered import running_totals
from hazardlake.session import materialize

BLOCK = 64  # features of a block
LEAST_ROWS = 1 << 16  # rows that make a range of its own worth while
SPREAD = 600.0  # widest span of eta whose exponentials share one scale
LAID = "t int, time double, os double, x array<double>"


@dataclass
class Risk:
    """Sums over a risk set and their logarithmic scale: s[k] e^top is the sum of x^k e^eta."""

    top: np.ndarray
    s: np.ndarray  # 3 x block

    @staticmethod
    def empty(width: int) -> Risk:
        return Risk(np.full(width, -np.inf), np.zeros((3, width)))

    def at(self, top: np.ndarray) -> np.ndarray:
        """The sums at another scale."""
        with np.errstate(invalid="ignore"):
            f = np.exp(self.top - top)
        return self.s * np.where(np.isfinite(self.top), f, 0.0)

    def plus(self, other: Risk) -> Risk:
        top = np.maximum(self.top, other.top)
        return Risk(top, self.at(top) + other.at(top))


def _terms(x: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x without gaps, eta with -inf in gaps, presence)."""
    seen = ~np.isnan(x)
    z = np.where(seen, x, 0.0)
    return z, np.where(seen, z * beta, -np.inf), seen


def _sums(z: np.ndarray, eta: np.ndarray, top: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        w = np.exp(eta - np.where(np.isfinite(top), top, 0.0))
    return np.stack([w, z * w, z * z * w])


class Descent:
    """Runs down the times of one (block, range) and adds up what the models need."""

    def __init__(self, beta: np.ndarray, later: Risk, one_time: bool):
        self.beta, self.run, self.one_time = beta, later, one_time
        width = len(beta)
        self.out = np.zeros((3, width))  # log-likelihood, gradient, curvature
        self.open: tuple[float, Risk, np.ndarray] | None = None  # a time that may go on in the next rows

    def _events(self, top, s, d):
        """Times with their risk sums (3 x times x block) and event counts (times x block)."""
        there = d > 0
        s0 = np.where(there, s[0], 1.0)
        mean = np.where(there, s[1] / s0, 0.0)
        log = np.where(there, np.log(s0) + np.where(np.isfinite(top), top, 0.0), 0.0)
        self.out[0] -= (d * log).sum(axis=0)
        self.out[1] -= (d * mean).sum(axis=0)
        self.out[2] += (d * (np.where(there, s[2] / s0, 0.0) - mean * mean)).sum(axis=0)

    def _close(self):
        if self.open is not None:
            _, own, d = self.open
            self.run = self.run.plus(own)
            self._events(self.run.top, self.run.s[:, None, :], d[None, :])
            self.open = None

    def rows(self, time: np.ndarray, os: np.ndarray, x: np.ndarray) -> None:
        z, eta, seen = _terms(x, self.beta)
        events = seen * os[:, None]
        self.out[0] += (np.where(events > 0, eta, 0.0) * events).sum(axis=0)
        self.out[1] += (z * events).sum(axis=0)
        if self.one_time:  # every row of the time is in the offset already
            self._events(self.run.top, self.run.s[:, None, :], events.sum(axis=0)[None, :])
        else:
            self._fold(time, z, eta, events)

    def _fold(self, time, z, eta, events):
        start = np.flatnonzero(np.append(True, time[1:] != time[:-1]))
        high = eta.max(axis=0)
        low = np.where(np.isfinite(eta), eta, np.inf).min(axis=0)
        if len(start) > 1 and (np.where(np.isfinite(high), high - low, 0.0) > SPREAD).any():
            half = start[len(start) // 2]
            self._fold(time[:half], z[:half], eta[:half], events[:half])
            self._fold(time[half:], z[half:], eta[half:], events[half:])
            return
        s = np.add.reduceat(_sums(z, eta, high), start, axis=1)
        d = np.add.reduceat(events, start, axis=0)
        if self.open is not None and self.open[0] == time[0]:
            _, own, before = self.open
            both = own.plus(Risk(high, s[:, 0]))
            d[0] += before
            self.open = None
            # the scale of all times is the larger one
            s = Risk(high, s.transpose(1, 0, 2)).at(both.top).transpose(1, 0, 2) if (both.top > high).any() else s
            high = both.top
            s[:, 0] = both.s
        self._close()
        if len(start) > 1:
            top = np.maximum(self.run.top, high)
            scaled = Risk(high, s[:, :-1].transpose(1, 0, 2)).at(top).transpose(1, 0, 2)
            upto = self.run.at(top)[:, None, :] + np.cumsum(scaled, axis=1)
            self._events(top, upto, d[:-1])
            self.run = Risk(top, upto[:, -1])
        self.open = (float(time[-1]), Risk(high, s[:, -1]), d[-1])

    def end(self) -> np.ndarray:
        self._close()
        return self.out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Consecutive rows of one key: (t, time, os, x)."""
    for batch in batches:
        t = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(t[1:] != t[:-1]) + 1).tolist(), len(t)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                part = to_numpy(batch.slice(a, b - a))
                yield int(t[a]), part["time"], part["os"], part["x"]


class Screen:
    """The dealt rows and the passes over them."""

    def __init__(self, rows: DataFrame, n_features: int, block: int, least_rows: int):
        spark = rows.sparkSession
        self.p, self.block = n_features, min(block, n_features)
        self.n_blocks = -(-self.p // self.block)
        slots = 4 * spark.sparkContext.defaultParallelism
        rows = rows.filter("os IS NOT NULL AND os_time IS NOT NULL").selectExpr("cast(os as double) os", "cast(os_time as double) os_time", "x")
        index = np.arange(self.p)
        center = column_means(rows, "x", index)

        def squares(batches):
            total = np.zeros((2, self_p))
            for b in batches:
                a = b["x"] - center
                seen = ~np.isnan(a)
                total += [np.where(seen, a * a, 0.0).sum(axis=0), seen.sum(axis=0)]
            return range(2), list(total)

        self_p = self.p
        total = np.zeros((2, self.p))
        for r in sum_vectors(rows.select("x"), squares).collect():  # two rows
            total[r["k"]] = r["v"]
        deviation = np.sqrt(total[0] / np.maximum(total[1], 1))
        self.scale = np.where(deviation > 0, deviation, 1.0)

        # ranges of times: as many as give every slot work, none longer than `size` rows but for single times
        counts = materialize(rows.groupBy("os_time").agg(F.count(F.lit(1)).alias("c")))
        n = counts.agg(F.sum("c")).first()[0] or 0
        size = max(least_rows, -(-n * self.n_blocks // slots))
        run = running_totals(counts, [], "os_time", ["c"])
        hot = F.col("c") > size
        range_ = F.floor((F.col("c_upto") - F.col("c")) / size) * 2 + hot.cast("int")
        pieces = F.when(hot, F.ceil(F.col("c") / size)).otherwise(1)
        found = run.groupBy(range_.alias("range")).agg(F.min("os_time").alias("lo"), F.max(pieces).alias("pieces"), F.max(hot).alias("hot"))
        made = found.orderBy("range").collect()  # bounded by slots
        self.lo = np.array([r["lo"] for r in made], dtype=float)
        self.hot = np.array([r["hot"] for r in made], dtype=bool)
        first = np.cumsum([0] + [r["pieces"] for r in made]).astype(np.int64)
        self.range_of = np.repeat(np.arange(len(made)), np.diff(first))
        self.laid = self._deal(rows, center, first, slots)

    def _deal(self, rows: DataFrame, center, first, slots) -> DataFrame:
        lo, scale, block, p, n_parts = self.lo, self.scale, self.block, self.p, len(self.range_of)

        def deal(batches):
            for batch in batches:
                b = to_numpy(batch)
                if not batch.num_rows:
                    continue
                z = (b["x"] - center) / scale
                at = np.searchsorted(lo, b["os_time"], "right") - 1
                part = first[at] + np.remainder(b["h"], first[at + 1] - first[at])
                for k in range(0, p, block):
                    x = np.ascontiguousarray(z[:, k : k + block])
                    offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
                    t = (k // block * n_parts + part).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(t), pa.array(b["os_time"]), pa.array(b["os"]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))],
                        names=["t", "time", "os", "x"],
                    )

        hashed = rows.withColumn("h", F.xxhash64("os", "os_time", "x"))
        n = max(1, min(slots, self.n_blocks * n_parts))
        dealt = hashed.mapInArrow(deal, LAID).repartition(n, "t").sortWithinPartitions("t", F.desc("time"))
        return materialize(dealt)

    def _later(self, beta: np.ndarray, working: set[int]) -> dict[int, Risk]:
        """What the risk sets of every key hold from later ranges; all of its own for single times."""
        block, n_parts = self.block, len(self.range_of)

        def totals(batches):
            held, risk = None, None
            for t, _, _, x in _runs(batches):
                if t // n_parts not in working:
                    continue
                if t != held:
                    if held is not None:
                        yield record(held, risk)
                    held, risk = t, Risk.empty(x.shape[1])
                k = t // n_parts * block
                z, eta, _ = _terms(x, beta[k : k + block])
                high = eta.max(axis=0)
                risk = risk.plus(Risk(high, _sums(z, eta, high).sum(axis=1)))
            if held is not None:
                yield record(held, risk)

        def record(t, risk):
            v = np.concatenate([risk.top, risk.s.ravel()])
            return pa.RecordBatch.from_arrays([pa.array([t], pa.int64()), pa.array([v.tolist()], pa.list_(pa.float64()))], names=["k", "v"])

        got: dict[tuple[int, int], Risk] = {}
        for r in self.laid.mapInArrow(totals, "k long, v array<double>").collect():  # a vector per (block, range)
            v = np.asarray(r["v"]).reshape(4, -1)
            key = (r["k"] // n_parts, int(self.range_of[r["k"] % n_parts]))
            part = Risk(v[0], v[1:])
            got[key] = got[key].plus(part) if key in got else part
        later = {}
        for b in working:
            width = min(self.block, self.p - b * self.block)
            run = Risk.empty(width)
            for g in range(len(self.lo) - 1, -1, -1):
                own = got.get((b, g), Risk.empty(width))
                for k in np.flatnonzero(self.range_of == g):
                    later[b * n_parts + int(k)] = run.plus(own) if self.hot[g] else run
                run = run.plus(own)
        return later

    def evaluate(self, beta: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Log-likelihood, gradient and curvature (3 x features); blocks without active features are passed over."""
        block, n_parts, hot, range_of = self.block, max(1, len(self.range_of)), self.hot, self.range_of
        working = {int(b) for b in np.unique(np.flatnonzero(active) // block)}
        single = n_parts == 1
        later = {} if single else self._later(beta, working)
        sent = self.laid.sparkSession.sparkContext.broadcast(later)  # a vector per (block, range)

        def steps(batches):
            held, walk = None, None
            for t, time, os, x in _runs(batches):
                if t // n_parts not in working:
                    continue
                if t != held:
                    if held is not None:
                        yield record(held, walk.end())
                    held, k = t, t // n_parts * block
                    known = sent.value.get(t)
                    start = Risk(known.top.copy(), known.s.copy()) if known is not None else Risk.empty(x.shape[1])
                    walk = Descent(beta[k : k + block], start, bool(hot[range_of[t % n_parts]]) and not single)
                walk.rows(time, os, x)
            if held is not None:
                yield record(held, walk.end())

        def record(t, out):
            return pa.RecordBatch.from_arrays([pa.array([t], pa.int64()), pa.array([out.ravel().tolist()], pa.list_(pa.float64()))], names=["k", "v"])

        total = np.zeros((3, self.p))
        for r in self.laid.mapInArrow(steps, "k long, v array<double>").collect():  # a vector per (block, range)
            k = r["k"] // n_parts * block
            total[:, k : k + block] += np.asarray(r["v"]).reshape(3, -1)
        sent.destroy()
        return total


def univariate_screen(rows: DataFrame, features: Sequence[str], max_iter: int = 25, block: int = BLOCK, least_rows: int = LEAST_ROWS) -> DataFrame:
    """``(feature, beta, lr, rank)`` by the likelihood-ratio statistic, ties in column order.

    ``rows``: os, os_time, x. Newton steps that lower the likelihood are halved; features that have
    converged no longer move. A constant or empty feature has beta 0 and statistic 0.
    """
    p = len(features)
    schema = "feature string, beta double, lr double, rank int"
    if not p:
        return rows.sparkSession.createDataFrame([], schema)
    screen = Screen(rows, p, block, least_rows)
    b, step, kept = np.zeros(p), np.zeros(p), np.zeros(p)
    best, null = np.full(p, -np.inf), None
    done = np.zeros(p, dtype=bool)
    for _ in range(max_iter):
        ll, g, h = screen.evaluate(b, ~done)
        null = ll if null is None else null
        worse = (ll < best - 1e-10 * np.abs(best)) & ~done
        ok = ~worse & ~done
        with np.errstate(invalid="ignore"):
            gain = ll - best
        kept, best = np.where(ok, b, kept), np.where(ok, ll, best)
        s = np.where(h > 1e-12, g / np.where(h > 1e-12, h, 1.0), 0.0)
        done |= ok & ((gain < 1e-10 * (np.abs(ll) + 1)) | (g * s < 1e-12))
        step = np.where(worse, step / 2, np.where(ok, s, step))
        b = np.where(done, kept, kept + step)
        if done.all():
            break
    lr = np.maximum(2 * (best - null), 0.0)
    order = sorted(range(p), key=lambda i: (-round(float(lr[i]), 6), i))
    table = [(features[i], float(kept[i] / screen.scale[i]), float(lr[i]), k + 1) for k, i in enumerate(order)]
    return rows.sparkSession.createDataFrame(table, schema)
