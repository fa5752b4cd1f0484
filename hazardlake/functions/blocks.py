"""Products of all pairs of columns of a wide matrix, block by block.

The columns are cut into blocks. For a pair of blocks (I, J), I <= J, six products hold all that a
correlation with pairwise missing values needs: counts, sums, squares and cross products over the rows in
which both columns are present. With one block every task multiplies its own rows. With
more, the rows travel in slabs: a slab goes to the pairs of blocks as two slices, so
each (pair, salt) is multiplied in one task that holds six blocks, however many columns and
rows there are. Partial products meet by row of the block and are finished there, so no
table of p x p cells exists unless the caller asks for every pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hazardlake.functions.gram import sum_vectors, to_numpy

BLOCK = 1024  # columns of a block: six products of 8 MB
SLAB_BYTES = 16 << 20
PARTS = 6  # products of a pair of blocks: n, sx, sy, sxx, syy, sxy
SLICES = "pair long, i int, j int, salt int, rows int, left binary, right binary"
PARTIAL = "key long, i int, j int, u int, v array<double>"


def column_means(vectors: DataFrame, x: str, index: np.ndarray) -> np.ndarray:
    """Mean of every chosen column over its present values; 0 for an empty one."""
    p = len(index)

    def partial(batches):
        total = np.zeros((2, p))
        for b in batches:
            a = b["x"][:, index]
            seen = ~np.isnan(a)
            total += [np.where(seen, a, 0.0).sum(axis=0), seen.sum(axis=0)]
        return range(2), list(total)

    total = np.zeros((2, p))
    for r in sum_vectors(vectors.selectExpr(f"{x} AS x"), partial).collect():  # two rows
        total[r["k"]] = r["v"]
    return total[0] / np.maximum(total[1], 1)


def multiply(left: np.ndarray, right: np.ndarray, out: np.ndarray) -> None:
    """Add the six products of two slices of the same rows to ``out``."""
    a, b = ~np.isnan(left), ~np.isnan(right)
    if a.all() and b.all():  # one product instead of six
        out[0] += len(left)
        out[1] += left.sum(axis=0)[:, None]
        out[2] += right.sum(axis=0)[None, :]
        out[3] += (left * left).sum(axis=0)[:, None]
        out[4] += (right * right).sum(axis=0)[None, :]
        out[5] += left.T @ right
        return
    x, y, a, b = np.where(a, left, 0.0), np.where(b, right, 0.0), a.astype(float), b.astype(float)
    for k, (s, t) in enumerate(((a, b), (x, b), (a, y), (x * x, b), (a, y * y), (x, y))):
        out[k] += s.T @ t


def _rows_of(i: int, j: int, nb: int, out: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A block of products as one vector per row."""
    width = out.shape[1]
    flat = np.ascontiguousarray(out.transpose(1, 0, 2)).ravel()
    v = pa.ListArray.from_arrays(pa.array(np.arange(width + 1, dtype=np.int32) * PARTS * out.shape[2]), pa.array(flat))
    u = np.arange(width, dtype=np.int32)
    key = (np.int64(i) * nb + j) * 1_000_000_007 + u
    yield pa.RecordBatch.from_arrays(
        [pa.array(key), pa.array(np.full(width, i, np.int32)), pa.array(np.full(width, j, np.int32)), pa.array(u), v], names=["key", "i", "j", "u", "v"]
    )


def block_products(vectors: DataFrame, x: str, index: np.ndarray, center: np.ndarray, block: int = BLOCK) -> DataFrame:
    """Partial products, to be summed by key: (key, i, j, u, v), ``v`` the six products of column u of block i with block j."""
    p = len(index)
    nb = -(-p // block)
    spans = [(k * block, min(p, (k + 1) * block)) for k in range(nb)]
    rows = vectors.selectExpr(f"{x} AS x")

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        most = max(1, SLAB_BYTES // (8 * p))
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                a = to_numpy(batch.slice(start, most))["x"][:, index] - center
                if len(a):
                    yield a

    if nb == 1:

        def whole(batches):
            out = np.zeros((PARTS, p, p))
            for a in centred(batches):
                multiply(a, a, out)
            yield from _rows_of(0, 0, 1, out)

        return rows.mapInArrow(whole, PARTIAL)

    pairs = [(i, j) for i in range(nb) for j in range(i, nb)]
    # several tasks share a pair where there are fewer pairs than slots
    salts = max(1, -(-2 * vectors.sparkSession.sparkContext.defaultParallelism // len(pairs)))

    def slabs(batches):
        for at, a in enumerate(centred(batches)):
            cut = [np.ascontiguousarray(a[:, lo:hi]).tobytes() for lo, hi in spans]
            for k, (i, j) in enumerate(pairs):
                yield pa.RecordBatch.from_pydict(
                    {
                        "pair": pa.array([k], pa.int64()), "i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()),
                        "salt": pa.array([at % salts], pa.int32()), "rows": pa.array([len(a)], pa.int32()),
                        "left": pa.array([cut[i]], pa.binary()), "right": pa.array([cut[j] if i != j else b""], pa.binary()),
                    }
                )

    def products(batches):
        held, out = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                i, j, salt, n = (batch.column(c)[k].as_py() for c in (1, 2, 3, 4))
                if (i, j, salt) != held:
                    if held is not None:
                        yield from _rows_of(*held[:2], nb, out)
                    held = (i, j, salt)
                    out = np.zeros((PARTS, spans[i][1] - spans[i][0], spans[j][1] - spans[j][0]))
                left = np.frombuffer(batch.column(5)[k].as_buffer(), float).reshape(n, -1)
                right = left if i == j else np.frombuffer(batch.column(6)[k].as_buffer(), float).reshape(n, -1)
                multiply(left, right, out)
        if held is not None:
            yield from _rows_of(*held[:2], nb, out)

    dealt = rows.mapInArrow(slabs, SLICES).repartition(len(pairs) * salts, "pair", "salt").sortWithinPartitions("pair", "salt")
    return dealt.mapInArrow(products, PARTIAL)


def finish(partial: DataFrame, apply: Callable[[int, int, int, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Sum partial products by key and hand every row of a block, a (6, width) array, to ``apply``."""

    def run(batches):
        held, total = None, None
        for batch in batches:
            starts, flat = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy(zero_copy_only=False)
            where = list(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))))
            for k, at in enumerate(where):
                v = flat[starts[k] : starts[k + 1]].reshape(PARTS, -1)
                if at == held:
                    total += v
                    continue
                if held is not None:
                    yield from apply(*held, total)
                held, total = at, v.astype(float)
        if held is not None:
            yield from apply(*held, total)

    return partial.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def correlations(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(r, n) of one column with a block; NaN for constant or never jointly present pairs."""
    n, sx, sy, sxx, syy, sxy = total
    with np.errstate(divide="ignore", invalid="ignore"):
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        ok = (n > 1) & (vx > 1e-12 * sxx) & (vy > 1e-12 * syy)
        r = np.where(ok, (sxy - sx * sy / n) / np.sqrt(np.where(ok, vx * vy, 1.0)), np.nan)
    return r, n


def pair_rows(features: Sequence[str], block: int, threshold: float | None, absolute: bool) -> Callable:
    """What `finish` applies: pairs (i, j, f1, f2, r, n), i > j, all of them or those from the threshold on."""
    names = np.asarray(features, dtype=object)

    def apply(bi: int, bj: int, u: int, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        j, i = bi * block + u, bj * block + np.arange(total.shape[1])
        r, n = correlations(total)
        good = i > j
        if threshold is not None:
            with np.errstate(invalid="ignore"):
                good &= (np.abs(r) if absolute else r) >= threshold
        if good.any():
            i, r, n = i[good], r[good], n[good]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(i.astype(np.int32)), pa.array(np.full(len(i), j, np.int32)), pa.array([names[j]] * len(i), pa.string()),
                    pa.array(names[i].tolist(), pa.string()), pa.array(r, mask=np.isnan(r)), pa.array(n.astype(np.int64)),
                ],
                names=["i", "j", "f1", "f2", "r", "n"],
            )

    return apply
