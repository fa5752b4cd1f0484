"""Registered queries: nearest-neighbour estimators on the vector table."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sqltext as S
from checks.queries import q, r6
from hazardlake import fixtures as X
from hazardlake.operators import neighbors

_VEC = """ev AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"""


def _j(axis: int, expr: str) -> str:
    return f"({expr} + CAST(1e-10 AS DOUBLE)*(CAST({S.h(f"'{axis}:'||id")} AS DOUBLE)/CAST({float(16**15)!r} AS DOUBLE)))"


# psi of whole numbers up to the table size
_PSI = """psi AS (SELECT n, -0.57721566490153286061 + coalesce(sum(CAST(1 AS DOUBLE)/(n-1)) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) , 0) AS v FROM
  (SELECT unnest(range(2, 200002)) AS n) UNION ALL SELECT 1, -0.57721566490153286061)"""


def dim_points(d: int, noise: bool = True) -> str:
    vals = [f"x[g+{a + 1}]" for a in range(d)]
    cols = ", ".join(f"{_j(a, v) if noise else v} AS a{a}" for a, v in enumerate(vals))
    return f"pt AS (SELECT g, id, label, {cols} FROM ev, (SELECT unnest(range(0, {65 - d})) AS g))"


def dist(d: int, a="p", b="q", axes=None) -> str:
    parts = [f"abs({a}.a{i}-{b}.a{i})" for i in (axes if axes is not None else range(d))]
    return f"greatest({', '.join(parts)})" if len(parts) > 1 else parts[0]


def kth(d: int, k: int, by: str = "p.g=q.g") -> str:
    return f"""kd AS (SELECT g, id, dd AS r FROM (SELECT p.g, p.id, {dist(d)} AS dd, row_number() OVER (PARTITION BY p.g, p.id ORDER BY {dist(d)}) AS rn FROM pt p JOIN pt q ON {by}) WHERE rn = {k + 1})"""


def points(spark, sf, d: int, extra=()):
    v = X.wide_vectors(spark, sf)
    g = F.explode(F.sequence(F.lit(0), F.lit(64 - d))).alias("g")
    return v.select(F.col("row_id").alias("id"), *extra, "x", g).select("g", "id", *extra, F.slice("x", F.col("g") + 1, d).alias("v"))


@q("knn_entropy", S.with_(_VEC, dim_points(1), _PSI, kth(1, 3)) + """SELECT CAST(g AS INTEGER) AS g, round(((SELECT v FROM psi WHERE n=cnt) - (SELECT v FROM psi WHERE n=3) + ln(2) + m)/ln(2),6)+0.0 AS entropy
 FROM (SELECT g, count(*) AS cnt, avg(ln(r)) AS m FROM kd GROUP BY g)""")
def knn_entropy(spark, sf):
    return neighbors.knn_entropy(points(spark, sf, 1)).select("g", r6(F.col("entropy"), "entropy"))


def mean_psi(name: str, axes: list[int]) -> str:
    return f"""{name} AS (SELECT g, avg(psi.v) AS m FROM (SELECT p.g, p.id, count(*) AS c FROM pt p JOIN kd ON p.g=kd.g AND p.id=kd.id JOIN pt q ON p.g=q.g AND {dist(0, axes=axes)} <= kd.r - 1e-15 GROUP BY ALL) JOIN psi ON psi.n=c GROUP BY g)"""


@q("ksg_mi", S.with_(_VEC, dim_points(2), _PSI, kth(2, 3), mean_psi("ma", [0]), mean_psi("mb", [1])) +
   "SELECT CAST(g AS INTEGER) AS g, round((-ma.m-mb.m+(SELECT v FROM psi WHERE n=3)+(SELECT v FROM psi WHERE n=(SELECT count(*) FROM ev)))/ln(2),6)+0.0 AS mi FROM ma JOIN mb USING (g)")
def ksg_mi(spark, sf):
    return neighbors.ksg_mi(points(spark, sf, 2)).select("g", r6(F.col("mi"), "mi"))


@q("ksg_cmi", S.with_(_VEC, dim_points(3), _PSI, kth(3, 3), mean_psi("ma", [0, 2]), mean_psi("mb", [1, 2]), mean_psi("mc", [2])) +
   "SELECT CAST(g AS INTEGER) AS g, round((-ma.m-mb.m+mc.m+(SELECT v FROM psi WHERE n=3))/ln(2),6)+0.0 AS cmi FROM ma JOIN mb USING (g) JOIN mc USING (g)")
def ksg_cmi(spark, sf):
    return neighbors.ksg_cmi(points(spark, sf, 3)).select("g", r6(F.col("cmi"), "cmi"))


@q("knn_kl_divergence", S.with_(_VEC, dim_points(2, False),
   "o AS (SELECT g, id, dd AS r FROM (SELECT p.g, p.id, " + dist(2) + " AS dd, row_number() OVER (PARTITION BY p.g, p.id ORDER BY " + dist(2) + ") AS rn FROM pt p JOIN pt q ON p.g=q.g AND p.label<5 AND q.label<5) WHERE rn=4)",
   "c AS (SELECT g, id, dd AS r FROM (SELECT p.g, p.id, " + dist(2) + " AS dd, row_number() OVER (PARTITION BY p.g, p.id ORDER BY " + dist(2) + ") AS rn FROM pt p JOIN pt q ON p.g=q.g AND p.label<5 AND q.label>=5) WHERE rn=3)") +
   """SELECT CAST(g AS INTEGER) AS g, round((ln(m) - ln(n-1) + 2*b - 2*a)/ln(2),6)+0.0 AS kl FROM (SELECT g, count(*) AS n, avg(ln(r)) AS a FROM o GROUP BY g) JOIN (SELECT g, avg(ln(r)) AS b FROM c GROUP BY g) USING (g),
 (SELECT count(*) AS m FROM ev WHERE label>=5)""")
def knn_kl_divergence(spark, sf):
    p = points(spark, sf, 2, ["label"])
    return neighbors.knn_kl_divergence(p.filter("label < 5"), p.filter("label >= 5")).select("g", r6(F.col("kl"), "kl"))


@q("mixed_mi", S.with_(_VEC, dim_points(1), _PSI, kth(1, 3), kth(1, 3, "p.g=q.g AND p.label=q.label").replace("kd AS", "ky AS"),
   "hx AS (SELECT g, cnt, ((SELECT v FROM psi WHERE n=cnt) - (SELECT v FROM psi WHERE n=3) + ln(2) + m)/ln(2) AS h FROM (SELECT g, count(*) AS cnt, avg(ln(r)) AS m FROM kd GROUP BY g))",
   "hy AS (SELECT g, label, ((SELECT v FROM psi WHERE n=cnt) - (SELECT v FROM psi WHERE n=3) + ln(2) + m)/ln(2) AS h FROM (SELECT ky.g, label, count(*) AS cnt, avg(ln(r)) AS m FROM ky JOIN ev USING (id) GROUP BY ALL))",
   "sz AS (SELECT label, count(*) AS ny FROM ev GROUP BY label)") +
   "SELECT CAST(hx.g AS INTEGER) AS g, round(max(hx.h) - sum(CAST(ny AS DOUBLE)/cnt*coalesce(hy.h, hx.h)),6)+0.0 AS mi FROM hx CROSS JOIN sz LEFT JOIN hy ON hy.g=hx.g AND hy.label=sz.label GROUP BY hx.g")
def mixed_mi(spark, sf):
    return neighbors.mixed_mi(points(spark, sf, 1, ["label"])).select("g", r6(F.col("mi"), "mi"))
