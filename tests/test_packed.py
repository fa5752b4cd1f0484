"""Passes of Cox fits read packed rows; models and groups share their rows."""

import numpy as np
import pyarrow as pa
import pytest

from hazardlake.functions import gram
from hazardlake.operators import boosting, cox, modelling

SCHEMA = "row_id int, os int, os_time double, fold int, x array<double>"


@pytest.fixture
def train(spark):
    r = np.random.default_rng(5)
    rows = []
    for i in range(4000):
        x = r.normal(3.0, 1.0, 2)
        fold = None if i % 97 == 0 else i % 3
        rows.append((i, int(r.random() < 0.7), float(1 + int(r.exponential(40) * np.exp(-0.4 * (x[0] - 3)))), fold, x.tolist()))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_slabs_hold_every_row_once(train):
    prob = cox.CoxProblem(train, 2, [0, -1], centered=True)
    assert 0 < prob.packed.count() <= 12
    held = train.filter("fold = 0").count()
    assert prob.seen().tolist() == [4000 - held, 4000]
    assert np.allclose(prob.center, cox.feature_means(train, 2))


def test_slabs_are_cut_by_bytes(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"os": [1] * 100, "os_time": [float(i % 7) for i in range(100)], "x": [[1.0, float(i)] for i in range(100)]})

    class Frame:
        columns = batch.schema.names
        mapInArrow = lambda self, run, schema: list(run(iter([batch])))

    monkeypatch.setattr(gram, "SLAB_BYTES", 1000)
    back = [b for p in gram.pack_rows(Frame(), lambda t: t) for b in gram.slabs(p)]
    assert len(back) > 3
    assert np.concatenate([b["x"] for b in back]).tolist() == batch.column("x").to_pylist()
    assert np.concatenate([b["at"] for b in back]).tolist() == [i % 7 for i in range(100)]


def test_packed_equals_joined(train):
    for fit, configs in ((cox.fit_ridge, [2.0] * 2), (boosting.fit_componentwise, [(2, 0.8)] * 2)):
        packed = fit(train, ["a", "b"], configs, [0, 2])
        joined = fit(train, ["a", "b"], configs, [0, 2], max_time_cells=2)
        for a, b in zip(packed, joined):
            assert np.allclose(a.coef, b.coef, atol=1e-8) and np.isclose(a.loglik, b.loglik)
            assert np.allclose(a.center, b.center)


def test_pool_makes_its_rows_once(spark, train, monkeypatch):
    data = train.selectExpr("row_id", "IF(row_id % 4 = 0, 'test', 'train') AS split", "'t' AS type", "os", "os_time", "x[0] AS a", "x[1] AS b")
    made = []
    real = modelling.materialize
    monkeypatch.setattr(modelling, "materialize", lambda df: made.append("x" in df.columns) or real(df))
    grids = {"CPH-L2": {"alpha": [1.0]}, "CLS-GB": {"n_estimators": [2], "learning_rate": [0.8]}}
    out = modelling.model_pool(data, ["a", "b"], list(grids), grids)
    assert [t.model for t in out] == list(grids) and made.count(True) == 1
    assert all(t.predictions.count() == 4000 for t in out)
