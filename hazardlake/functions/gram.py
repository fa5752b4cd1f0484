"""Adding up vectors that each task produces from its own rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "k bigint, v array<double>"
SLAB_BYTES = 1 << 20


def to_numpy(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Columns as arrays; an array column becomes a matrix, null becomes NaN."""
    out = {}
    for name, col in zip(batch.schema.names, batch.columns):
        if pa.types.is_list(col.type):
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(float)
            out[name] = flat.reshape(batch.num_rows, -1)
        else:
            out[name] = col.to_numpy(zero_copy_only=False)
    return out


def pack_rows(df: DataFrame, index: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Rows ``(os, os_time, x[, fold])`` without nulls in the first two as slabs of at most ``SLAB_BYTES`` or one row.

    A slab is one row of binary columns: ``os``, ``x`` and ``fold`` as doubles (null becomes NaN), ``at`` the
    32-bit numbers that ``index`` gives the times. Passes over slabs read whole matrices, no values of rows.
    """
    fold = "fold" in df.columns

    def run(batches):
        for batch in batches:
            most = max(1, SLAB_BYTES // max(1, batch.nbytes // max(1, batch.num_rows)))
            for start in range(0, batch.num_rows, most):
                b = to_numpy(batch.slice(start, most))
                cut = [b["os"].astype(float), index(b["os_time"].astype(float)).astype(np.int32), b["x"]]
                cut += [b["fold"].astype(float)] if fold else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(b["os"])], pa.int32())] + [pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in cut],
                    names=["n", "os", "at", "x"] + ["fold"] * fold,
                )

    return df.mapInArrow(run, "n int, os binary, at binary, x binary" + ", fold binary" * fold)


def slabs(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
    """The rows that `pack_rows` packed, slab by slab; arrays are views."""
    kinds = {"os": float, "at": np.int32, "x": float, "fold": float}
    for i, n in enumerate(batch.column("n").to_pylist()):
        b = {c: np.frombuffer(batch.column(c)[i].as_buffer(), kinds[c]) for c in batch.schema.names if c in kinds}
        yield b | {"x": b["x"].reshape(n, -1)}


def _record(keys, vectors: list[np.ndarray]) -> pa.RecordBatch:
    sizes = np.cumsum([0] + [len(v) for v in vectors]).astype(np.int32)
    flat = np.concatenate(vectors) if vectors else np.zeros(0)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(keys, dtype=np.int64)), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))], names=["k", "v"]
    )


def _stream_sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add vectors of equal key as they stream by; holds one vector per key."""
    acc: dict[int, np.ndarray] = {}
    for b in batches:
        starts = b.column("v").offsets.to_numpy()
        flat = b.column("v").values.to_numpy(zero_copy_only=False)
        for i, k in enumerate(b.column("k").to_pylist()):
            part = flat[starts[i] : starts[i + 1]]
            if k in acc:
                acc[k] += part
            else:
                acc[k] = np.array(part, dtype=float)
    for k, v in acc.items():
        yield _record([k], [v])


def _numbers(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
    if batch.num_rows:
        yield to_numpy(batch)


def sum_vectors(df: DataFrame, partial: Callable[[Iterator[dict]], tuple], read: Callable[[pa.RecordBatch], Iterator[dict]] = _numbers) -> DataFrame:
    """``(k, v)``: vectors from ``partial`` (run once per task) summed per key.

    ``partial`` takes the task's batches as dicts of arrays (one or, from ``read``,
    several per Arrow batch) and returns keys and vectors.  Input splits are first merged down to a few per core, without a
    shuffle, so the number of partial vectors follows the cluster, not the data.
    """
    slots = max(1, 4 * df.sparkSession.sparkContext.defaultParallelism)

    def run(batches):
        keys, vectors = partial(part for b in batches for part in read(b))
        for k, v in zip(keys, vectors):
            yield _record([k], [v])

    return df.coalesce(slots).mapInArrow(run, SCHEMA).repartition("k").mapInArrow(_stream_sum, SCHEMA)
