"""Run queries beside their SQL in DuckDB and compare whole results."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, query, sql, sf_dir) -> dict:
    t0 = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    out = {"name": name, "rows": len(got), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        return out | {"ok": None}
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    exp = cur.fetchall()
    out["sql_sec"] = round(time.time() - t1, 2)
    if sorted(names) != sorted(df.columns):
        return out | {"ok": False, "why": f"columns {sorted(df.columns)} / {sorted(names)}"}
    a, b = _rows(df.columns, got), _rows(names, exp)
    if a == b:
        return out | {"ok": True}
    diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
    return out | {"ok": False, "why": f"{len(a)} / {len(b)} rows; {diff}"}
