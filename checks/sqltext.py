"""SQL for the derived survival tables, written for an engine other than Spark."""

from __future__ import annotations

NUM = [
    "totalprice_exp", "nlines_exp", "qty_exp", "qtydup_exp", "ext_exp",
    "disc_mut", "tax_mut", "nret_mut", "const_pr", "unit_pr",
]
FULL = ["acctbal_clin", *NUM]
MODALITY = {"_clin": "CLINICAL", "_exp": "EXPRESSION", "_mut": "MUTATION", "_pr": "PYRADIOMICS"}

_LI = """li AS (SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS n_lines, sum(l_quantity) AS qty, sum(l_extendedprice) AS ext,
    avg(l_discount) AS disc, avg(l_tax) AS tax,
    CAST(sum(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS DOUBLE) AS n_ret
  FROM lineitem GROUP BY l_orderkey)"""
_ORD = """ord AS (SELECT o.*, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_dt,
    max(o_orderdate) OVER () AS end_dt FROM orders o)"""
_SURV = """surv AS (SELECT o_orderkey AS row_id, o_custkey AS subject_id, c_mktsegment AS type, r_name AS study,
  o_orderpriority AS pdl1_status,
  CASE WHEN next_dt IS NULL THEN 0 ELSE 1 END AS os,
  CAST(1 + date_diff('day', o_orderdate, coalesce(next_dt,end_dt)) AS DOUBLE) AS os_time,
  c_acctbal AS acctbal_clin, o_orderstatus AS status_clin, n_name AS nation_clin,
  o_totalprice AS totalprice_exp, n_lines AS nlines_exp, qty AS qty_exp, 2.0*qty+1.0 AS qtydup_exp, ext AS ext_exp,
  disc AS disc_mut, tax AS tax_mut, n_ret AS nret_mut, CAST(1.0 AS DOUBLE) AS const_pr, ext/qty AS unit_pr
FROM ord JOIN customer ON c_custkey=o_custkey JOIN nation ON n_nationkey=c_nationkey
JOIN region ON r_regionkey=n_regionkey LEFT JOIN li ON l_orderkey=o_orderkey)"""
SURV = f"{_LI},\n{_ORD},\n{_SURV}"


def h(text: str, digits: int = 15) -> str:
    """First hex digits of md5 as an integer."""
    return f"CAST(('0x'||substr(md5({text}),1,{digits})) AS BIGINT)"


COHORTS = f"""cohorts AS (SELECT subject_id, study, CASE WHEN hh<60 THEN 'training' WHEN hh<80 THEN 'validation' ELSE 'test' END AS cohort
  FROM (SELECT DISTINCT subject_id, study, {h("'c:'||CAST(subject_id AS VARCHAR)", 8)} % 100 AS hh FROM surv))"""

PREDICTIONS = f"""pred0 AS (SELECT run, row_id, model, modality, type, os, os_time,
    {h("CAST(run AS VARCHAR)||':'||CAST(row_id AS VARCHAR)", 8)} % 100 AS s,
    ({h("CAST(run AS VARCHAR)||':'||CAST(row_id AS VARCHAR)||':'||model||':'||modality", 8)} % 1000)/CAST(1000.0 AS DOUBLE) AS u
  FROM surv, (SELECT unnest([1,2,3]) AS run), (SELECT unnest(['GOOD','WEAK','ANTI','CONST']) AS model),
    (SELECT unnest(['EXPRESSION','MUTATION']) AS modality)),
predictions AS (SELECT CAST(run AS INTEGER) AS run, CASE WHEN s<60 THEN 'train' WHEN s<80 THEN 'val' ELSE 'test' END AS split,
    row_id, model, modality, type, os, os_time,
    CASE model WHEN 'GOOD' THEN CAST(-0.5 AS DOUBLE)*ln(os_time)+u WHEN 'WEAK' THEN CAST(-0.05 AS DOUBLE)*ln(os_time)+u
      WHEN 'ANTI' THEN CAST(0.3 AS DOUBLE)*ln(os_time)+u ELSE CAST(1.0 AS DOUBLE) END AS risk FROM pred0)"""


def long_cte(source: str, features: list[str], ids: str = "row_id", name: str = "lng") -> str:
    names = ", ".join(f"'{f}'" for f in features)
    vals = ", ".join(f"CAST({f} AS DOUBLE)" for f in features)
    return f"{name} AS (SELECT {ids}, unnest([{names}]) AS feature, unnest([{vals}]) AS value FROM {source})"


def features_cte(features: list[str], name: str = "dict") -> str:
    rows = ", ".join(
        f"('{f}', '{MODALITY['_' + f.rsplit('_', 1)[1]]}', {i})" for i, f in enumerate(features)
    )
    return f"{name}(feature, modality, pos) AS (VALUES {rows})"


def subject_split(seed: int, fraction: float, source: str = "surv", name: str = "split_of") -> str:
    """Distinct subjects in md5 order; the first int(fraction * m) are train."""
    return f"""{name} AS (SELECT subject_id, CASE WHEN rk <= floor(CAST({fraction!r} AS DOUBLE) * m) THEN 'train' ELSE 'test' END AS split FROM
  (SELECT subject_id, row_number() OVER (ORDER BY md5('{seed}:'||CAST(subject_id AS VARCHAR)), subject_id) AS rk, count(*) OVER () AS m
   FROM (SELECT DISTINCT subject_id FROM {source})))"""


def quantile_bins(source: str, n_bins: int, by: str = "feature", name: str = "edges", value: str = "value") -> str:
    """Kept inner edges, one row each."""
    qs = ", ".join(f"CAST({i / n_bins!r} AS DOUBLE)" for i in range(n_bins + 1))
    on = " AND ".join(f"a.{b.strip()}=b.{b.strip()}" for b in by.split(","))
    return f"""{name}_q AS (SELECT {by}, [{', '.join(f'quantile_cont({value}, {i / n_bins!r})' for i in range(n_bins + 1))}] AS q
    FROM {source} WHERE {value} IS NOT NULL GROUP BY {by}),
{name} AS (SELECT {by}, e FROM (SELECT {by}, q[i] AS e, q[i-1] AS b, q[{n_bins + 1}] AS mx
    FROM {name}_q, (SELECT unnest(range(2, {n_bins + 1})) AS i)) WHERE e - b > 1e-8 AND mx - e > 1e-8)"""


def binned(source: str, edges: str = "edges", ids: str = "row_id", by: str = "feature", name: str = "binned", value: str = "value") -> str:
    on = " AND ".join(f"l.{b.strip()}=x.{b.strip()}" for b in by.split(","))
    cols = ", ".join(f"l.{c.strip()}" for c in (ids + "," + by).split(","))
    return f"""{name} AS (SELECT {cols}, CAST(count(x.e) AS INTEGER) AS bin FROM {source} l
  LEFT JOIN {edges} x ON {on} AND x.e <= l.{value} WHERE l.{value} IS NOT NULL GROUP BY {cols})"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
