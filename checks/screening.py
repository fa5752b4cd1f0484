"""Registered queries: variance, correlation and information-theoretic screening."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sqltext as S
from checks.queries import ALL_LONG, IDS, TRAIN, TRAIN_LONG, dictionary, by_modality, long_train, q, r6, target_cte, train_part
from hazardlake import fixtures as X
from hazardlake.operators import information, preprocess, schema, stability, unsupervised
from hazardlake.session import materialize

# ---- without the target ------------------------------------------------------


@q("low_variance", TRAIN_LONG + "SELECT feature, round(stddev_pop(value),6)+0.0 AS sd, var_pop(value) > 0.05 AS kept FROM lng GROUP BY feature")
def low_variance(spark, sf):
    return unsupervised.low_variance(long_train(spark, sf), 0.05).select("feature", r6(F.sqrt("variance"), "sd"), "kept")


def train_vectors(spark, sf, features=S.FULL):
    return schema.as_vector(train_part(spark, sf).filter("split = 'train'"), features, ["row_id"])


PAIRS = """, pr AS (SELECT a.pos AS j, b.pos AS i, a.feature AS f1, b.feature AS f2, va, vb FROM
  (SELECT row_id, feature, value AS va, pos FROM lng JOIN dict USING (feature)) a JOIN
  (SELECT row_id, feature, value AS vb, pos FROM lng JOIN dict USING (feature)) b ON a.row_id=b.row_id AND a.pos < b.pos),
 cr AS (SELECT i, j, f1, f2, count(*) AS n, CASE WHEN min(va)=max(va) OR min(vb)=max(vb) THEN NULL ELSE corr(va, vb) END AS r
   FROM pr WHERE va IS NOT NULL AND vb IS NOT NULL GROUP BY ALL)
"""
DICT = "," + S.features_cte(S.FULL)


@q("pearson_matrix", TRAIN_LONG + DICT + PAIRS + "SELECT f1, f2, round(r,6)+0.0 AS r, n FROM cr")
def pearson_matrix(spark, sf):
    return unsupervised.pearson_pairs(train_vectors(spark, sf), S.FULL).select("f1", "f2", r6(F.col("r"), "r"), "n")


# the sweep in column order, one step per feature
_SWEEP = ", e AS (SELECT i, j FROM cr WHERE r >= 0.8), k0 AS (SELECT pos FROM dict WHERE pos = 0)" + "".join(
    f", k{i} AS (SELECT pos FROM k{i - 1} UNION ALL SELECT {i} WHERE NOT EXISTS (SELECT 1 FROM e JOIN k{i - 1} ON e.j = k{i - 1}.pos WHERE e.i = {i}))"
    for i in range(1, len(S.FULL))
)
_LASTK = f"k{len(S.FULL) - 1}"


@q("drop_correlated", TRAIN_LONG + DICT + PAIRS + _SWEEP + f" SELECT feature, pos IN (SELECT pos FROM {_LASTK}) AS kept FROM dict")
def drop_correlated(spark, sf):
    edges = unsupervised.correlated_edges(unsupervised.pearson_pairs(train_vectors(spark, sf), S.FULL), 0.8)
    kept = unsupervised.drop_correlated(materialize(edges), len(S.FULL))
    names = F.array(*[F.lit(f) for f in S.FULL])
    return kept.select(F.get(names, F.col("pos")).alias("feature"), "kept")


@q("group_correlated", TRAIN_LONG + DICT + PAIRS + _SWEEP + f""",
 mem AS (SELECT e.j, d.feature AS member FROM e JOIN {_LASTK} k ON e.j=k.pos JOIN dict d ON d.pos=e.i WHERE e.i NOT IN (SELECT pos FROM {_LASTK})),
 allm AS (SELECT * FROM mem UNION SELECT j, feature FROM mem JOIN dict ON dict.pos=mem.j),
 grp AS (SELECT member, 'group_' || min(member) OVER (PARTITION BY j) AS g FROM allm),
 outl AS (SELECT w.row_id, g AS feature, avg(value) AS value FROM (SELECT * FROM ({S.with_(S.long_cte('surv', S.FULL, name='w0'))}SELECT * FROM w0)) w JOIN grp ON grp.member=w.feature GROUP BY ALL
   UNION ALL SELECT row_id, feature, value FROM ({S.with_(S.long_cte('surv', S.FULL, name='w0'))}SELECT * FROM w0) WHERE feature NOT IN (SELECT member FROM grp))
SELECT feature, count(value) AS n, round(avg(value),6)+0.0 AS mean, round(sum(value*(row_id%7))/1e6,6)+0.0 AS checksum FROM outl GROUP BY feature""")
def group_correlated(spark, sf):
    edges = materialize(unsupervised.correlated_edges(unsupervised.pearson_pairs(train_vectors(spark, sf), S.FULL), 0.8))
    groups = unsupervised.correlation_groups(edges, unsupervised.drop_correlated(edges, len(S.FULL)))
    long = schema.melt(X.surv(spark, sf), S.FULL, ["row_id"])
    out = unsupervised.apply_groups(long, groups, ["row_id"])
    return out.groupBy("feature").agg(
        F.count("value").alias("n"), r6(F.avg("value"), "mean"), r6(F.sum(F.col("value") * F.pmod("row_id", F.lit(7))) / 1e6, "checksum")
    )


@q("unsupervised_dispatch", TRAIN_LONG + DICT + PAIRS + ", lv AS (SELECT feature FROM lng GROUP BY feature HAVING var_pop(value) > 0.05)"
   + ", e AS (SELECT i, j FROM cr WHERE r >= 0.8 AND f1 IN (SELECT feature FROM lv) AND f2 IN (SELECT feature FROM lv)), k0 AS (SELECT pos FROM dict WHERE pos = 0)" + "".join(
    f", k{i} AS (SELECT pos FROM k{i - 1} UNION ALL SELECT {i} WHERE NOT EXISTS (SELECT 1 FROM e JOIN k{i - 1} ON e.j = k{i - 1}.pos WHERE e.i = {i}))"
    for i in range(1, len(S.FULL)))
   + f" SELECT feature FROM dict WHERE feature IN (SELECT feature FROM lv) AND pos IN (SELECT pos FROM {_LASTK})")
def unsupervised_dispatch(spark, sf):
    train = materialize(train_part(spark, sf).filter("split = 'train'").select("row_id", *S.FULL))
    kept, _ = unsupervised.unsupervised_screen(
        schema.as_vector(train, S.FULL, ["row_id"]), schema.melt(train, S.FULL, ["row_id"]), S.FULL, "drop", 0.05, 0.8
    )
    return spark.createDataFrame([(f,) for f in kept], "feature string")


# ---- information theory ------------------------------------------------------

BINNED = TRAIN_LONG + DICT + "," + S.quantile_bins("lng", 10) + "," + S.binned("lng") + target_cte()
ENT = "-sum(c/n*log2(c/n))"


def ent(name: str, source: str, by: list[str], over: list[str], w: str = "count(*)") -> str:
    """CTE with the entropy of ``over`` per ``by``."""
    k = ", ".join(by + over)
    b = ", ".join(by)
    part = f"PARTITION BY {b}" if by else ""
    return f"""{name} AS (SELECT {b + ',' if by else ''} -sum(c/n*log2(c/n)) AS h FROM (SELECT {k}, CAST(c AS DOUBLE) AS c, sum(c) OVER ({part}) AS n FROM
  (SELECT {k}, {w} AS c FROM {source} GROUP BY {k})) {'GROUP BY ' + b if by else ''})"""


JY = "jy AS (SELECT b.row_id, feature, bin AS x, y FROM binned b JOIN y ON b.row_id=y.row_id)"
MI_CTE = ",\n".join([JY, ent("hx", "jy", ["feature"], ["x"]), ent("hy", "jy", ["feature"], ["y"]), ent("hxy", "jy", ["feature"], ["x", "y"]),
    "mi AS (SELECT feature, hx.h AS hx, hy.h AS hy, hxy.h AS hxy, greatest(hx.h+hy.h-hxy.h, 0) AS mi FROM hx JOIN hy USING (feature) JOIN hxy USING (feature))"])


def binned_train(spark, sf):
    train = materialize(train_part(spark, sf).filter("split = 'train'").select(*IDS, "subject_id", *S.FULL))
    long = schema.melt(train, S.FULL, ["row_id"])
    bins = preprocess.apply_bins(long, preprocess.fit_bins(long, 10), n_features=len(S.FULL)).select("row_id", "feature", "bin")
    y = preprocess.discretize_target(train.select("row_id", "os_time"), "os_time", "discrete").select("row_id", "y")
    return bins, y, train


def joint(spark, sf):
    bins, y, _ = binned_train(spark, sf)
    return materialize(information.joint_counts(bins, y))


@q("entropy_discrete", BINNED + "," + ent("hb", "binned", ["feature"], ["bin"]) + "SELECT feature, round(h,6)+0.0 AS entropy FROM hb")
def entropy_discrete(spark, sf):
    bins, _, _ = binned_train(spark, sf)
    return information.discrete_entropy(bins).select("feature", r6(F.col("entropy"), "entropy"))


@q("mutual_information", BINNED + "," + MI_CTE + "SELECT feature, round(mi,6)+0.0 AS mi FROM mi")
def mutual_information(spark, sf):
    return information.mutual_information(joint(spark, sf)).select("feature", r6(F.col("mi"), "mi"))


@q("conditional_entropy", BINNED + "," + MI_CTE + "SELECT feature, round(hxy-hy,6)+0.0 AS cond_entropy FROM mi")
def conditional_entropy(spark, sf):
    return information.mutual_information(joint(spark, sf)).select("feature", r6(F.col("cond_entropy"), "cond_entropy"))


@q("symmetrical_uncertainty", BINNED + "," + MI_CTE + "SELECT feature, round(CASE WHEN hx+hy>0 THEN 2*mi/(hx+hy) ELSE 0 END,6)+0.0 AS su FROM mi")
def symmetrical_uncertainty(spark, sf):
    return information.mutual_information(joint(spark, sf)).select("feature", r6(F.col("su"), "su"))


def with_pick(pick: str, name: str) -> str:
    """Joint rows with the bin of a picked feature; rows missing either drop out."""
    return f"{name} AS (SELECT a.row_id, a.feature, a.x, a.y, p.x AS s FROM jy a JOIN jy p ON a.row_id=p.row_id AND p.feature=({pick}))"


def red(name: str, src: str) -> str:
    """Redundancy with the picked feature, alone and given the target."""
    t = [ent(f"{name}_{v}", src, ["feature"], list(v)) for v in ("x", "s", "y", "xs", "xy", "sy", "xsy")]
    j = " ".join(f"JOIN {name}_{v} USING (feature)" for v in ("s", "y", "xs", "xy", "sy", "xsy"))
    g = lambda v: f"{name}_{v}.h"
    return ",\n".join(t + [f"""{name} AS (SELECT feature, {g('x')}+{g('s')}-{g('xs')} AS r, {g('sy')}+{g('xy')}-{g('xsy')}-{g('y')} AS g,
   CASE WHEN {g('xsy')}>0 THEN ({g('xs')}+{g('y')}-{g('xsy')})/{g('xsy')} ELSE 0 END AS ratio FROM {name}_x {j})"""])


@q("conditional_mi", BINNED + "," + JY + "," + with_pick("'qty_exp'", "j4") + "," + red("rd", "j4") + "SELECT feature, round(greatest(g,0),6)+0.0 AS cmi FROM rd")
def conditional_mi(spark, sf):
    bins, y, _ = binned_train(spark, sf)
    sel = bins.filter("feature = 'qty_exp'").select("row_id", F.col("bin").alias("s"))
    j = bins.join(sel, "row_id").join(y, "row_id").dropna(subset=["bin", "s", "y"])
    cells = j.groupBy("feature", F.col("bin").alias("x"), "s", "y").agg(F.count(F.lit(1)).alias("c"))
    return information.conditional_mi(cells).select("feature", r6(F.col("cmi"), "cmi"))


@q("mim", BINNED + "," + MI_CTE + """SELECT feature, round(mi,6)+0.0 AS mi, rank FROM (SELECT feature, mi, row_number() OVER (ORDER BY round(mi,10) DESC, pos) AS rank FROM mi JOIN dict USING (feature)) WHERE rank <= 5""")
def mim(spark, sf):
    """Flagship: subject split, bins fitted on train, ranking by I(f;y)."""
    bins, y, train = binned_train(spark, sf)
    mi = information.mutual_information(information.joint_counts(bins, y))
    return information.top_by_mi(mi, dictionary(train), 5).select("feature", r6(F.col("mi"), "mi"), "rank")


def packed(spark, sf):
    bins, y, train = binned_train(spark, sf)
    edges = preprocess.fit_bins(schema.melt(train, S.FULL, ["row_id"]), 10)
    vec = schema.as_vector(train, S.FULL, ["row_id"]).join(y, "row_id")
    return materialize(information.pack_bins(vec, edges, S.FULL))


def _greedy(method):
    def run(spark, sf):
        picks = information.greedy_select(packed(spark, sf), S.FULL, method, 3)
        return information.selection_table(spark, picks).select("feature", "rank", r6(F.col("score"), "score"))

    return run


_SCORES = {
    "mifs": "mi - 0.5*({r})", "mrmr": "mi - ({r})/{n}", "jmi": "mi - ({r})/{n} + ({g})/{n}", "cife": "mi - ({r}) + ({g})",
    "lcsi": "mi - 0.5*({r})", "cmim": "mi - greatest({w})", "icap": "mi - greatest(0, {w})", "disr": "{q}",
}


def greedy_sql(score: str) -> str:
    """Three unrolled greedy steps."""
    steps = [BINNED, MI_CTE, "p1 AS (SELECT feature, mi AS score FROM mi JOIN dict USING (feature) ORDER BY round(mi,10) DESC, pos LIMIT 1)"]
    for n in (1, 2):
        steps.append(with_pick(f"SELECT feature FROM p{n}", f"j{n}"))
        steps.append(red(f"r{n}", f"j{n}"))
        terms = {
            "r": " + ".join(f"r{i}.r" for i in range(1, n + 1)), "g": " + ".join(f"r{i}.g" for i in range(1, n + 1)),
            "w": ", ".join(f"r{i}.r - r{i}.g" for i in range(1, n + 1)), "q": " + ".join(f"r{i}.ratio" for i in range(1, n + 1)), "n": f"{n}.0",
        }
        joins = " ".join(f"JOIN r{i} USING (feature)" for i in range(1, n + 1))
        taken = " AND ".join(f"feature NOT IN (SELECT feature FROM p{i})" for i in range(1, n + 1))
        steps.append(f"p{n + 1} AS (SELECT feature, score FROM (SELECT feature, pos, {score.format(**terms)} AS score FROM mi JOIN dict USING (feature) {joins}) WHERE {taken} ORDER BY round(score,10) DESC, pos LIMIT 1)")
    tail = " UNION ALL ".join(f"SELECT feature, CAST({i} AS INTEGER) AS rank, round(score,6)+0.0 AS score FROM p{i}" for i in (1, 2, 3))
    return steps[0] + "," + ",\n".join(steps[1:]) + "\n" + tail


for _n in ("mifs", "mrmr", "jmi", "cife", "cmim", "icap", "disr"):
    q(_n, greedy_sql(_SCORES[_n]))(_greedy(_n.upper()))


@q("lcsi", greedy_sql("mi - 0.3*({r})"))
def lcsi(spark, sf):
    picks = information.greedy_select(packed(spark, sf), S.FULL, "MIFS", 3, beta=0.3)
    return information.selection_table(spark, picks).select("feature", "rank", r6(F.col("score"), "score"))


def _fcbf_sql(rounds: int) -> str:
    out = [BINNED, MI_CTE, "l0 AS (SELECT feature, pos, CASE WHEN hx+hy>0 THEN 2*mi/(hx+hy) ELSE 0 END AS su FROM mi JOIN dict USING (feature) WHERE mi > 0)"]
    for n in range(1, rounds + 1):
        out.append(f"p{n} AS (SELECT feature, su FROM l{n - 1} ORDER BY round(su,10) DESC, pos LIMIT 1)")
        out.append(f"j{n} AS (SELECT a.feature, a.x, p.x AS s FROM jy a JOIN jy p ON a.row_id=p.row_id AND p.feature=(SELECT feature FROM p{n}))")
        out += [ent(f"a{n}", f"j{n}", ["feature"], ["x"]), ent(f"b{n}", f"j{n}", ["feature"], ["s"]), ent(f"c{n}", f"j{n}", ["feature"], ["x", "s"])]
        out.append(f"""l{n} AS (SELECT l.* FROM l{n - 1} l LEFT JOIN a{n} USING (feature) LEFT JOIN b{n} USING (feature) LEFT JOIN c{n} USING (feature)
  WHERE feature NOT IN (SELECT feature FROM p{n}) AND round(CASE WHEN a{n}.h+b{n}.h>0 THEN 2*(a{n}.h+b{n}.h-c{n}.h)/(a{n}.h+b{n}.h) ELSE 0 END,10) < round(su,10))""")
    tail = " UNION ALL ".join(f"SELECT feature, CAST({n} AS INTEGER) AS rank, round(su,6)+0.0 AS su FROM p{n}" for n in range(1, rounds + 1))
    return out[0] + "," + ",\n".join(out[1:]) + "\n" + tail


@q("fcbf", _fcbf_sql(len(S.FULL)))
def fcbf(spark, sf):
    rows = [(r["feature"], r["rank"], r["su"]) for r in information.fcbf(packed(spark, sf), S.FULL)]
    return spark.createDataFrame(rows, "feature string, rank int, su double").select("feature", "rank", r6(F.col("su"), "su"))


_RHO = JY + """, rk AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1)/2.0 AS rx,
  rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1)/2.0 AS ry FROM jy),
 rho AS (SELECT feature, CASE WHEN min(rx)=max(rx) THEN NULL ELSE corr(rx, ry) END AS rho FROM rk GROUP BY feature)"""


@q("spearman_rank", BINNED + "," + _RHO + """SELECT feature, round(rho,6)+0.0 AS rho, rank FROM
 (SELECT feature, rho, row_number() OVER (ORDER BY round(abs(rho),10) DESC NULLS LAST, pos) AS rank FROM rho JOIN dict USING (feature)) WHERE rank <= 6""")
def spearman_rank(spark, sf):
    bins, y, train = binned_train(spark, sf)
    rho = information.spearman(information.joint_counts(bins, y))
    return information.top_by_rank_correlation(rho, dictionary(train), 6).select("feature", r6(F.col("rho"), "rho"), "rank")


@q("per_modality", BINNED + "," + MI_CTE + """SELECT modality, feature, rank FROM (SELECT modality, feature,
  row_number() OVER (PARTITION BY modality ORDER BY round(mi,10) DESC, pos) AS rank FROM mi JOIN dict USING (feature)) WHERE rank <= 2""")
def per_modality(spark, sf):
    names = list(X.SUFFIXES)
    of = {f: names.index(m) for m, fs in by_modality(S.FULL).items() for f in fs}
    picks = information.greedy_select(packed(spark, sf), S.FULL, "MIM", 2, [of[f] for f in S.FULL])
    rows = [(names[p["group"]], p["feature"], p["rank"]) for p in picks]
    return spark.createDataFrame(rows, "modality string, feature string, rank int")


_NPERM = 200


@q("permutation_test_mi", BINNED + "," + JY + f""", fx AS (SELECT row_id, x, y FROM jy WHERE feature='qty_exp'), pm AS (SELECT unnest(range(0,{_NPERM})) AS perm),
 xs AS (SELECT perm, x, row_number() OVER (PARTITION BY perm ORDER BY md5('1:x:'||perm||':'||row_id), row_id) AS k FROM fx, pm),
 ys AS (SELECT perm, y, row_number() OVER (PARTITION BY perm ORDER BY md5('1:y:'||perm||':'||row_id), row_id) AS k FROM fx, pm),
 jp AS (SELECT perm, x, y FROM xs JOIN ys USING (perm, k)), """ + ",\n".join([ent("ax", "jp", ["perm"], ["x"]), ent("ay", "jp", ["perm"], ["y"]), ent("axy", "jp", ["perm"], ["x", "y"])]) + f""",
 vals AS (SELECT list_sort(list(greatest(ax.h+ay.h-axy.h,0))) AS v, avg(greatest(ax.h+ay.h-axy.h,0)) AS m FROM ax JOIN ay USING (perm) JOIN axy USING (perm))
SELECT round(m,6)+0.0 AS mean, round(v[{int((1 - 0.95) / 2 * _NPERM) + 1}],6)+0.0 AS lower, round(v[{int((1 + 0.95) / 2 * _NPERM) + 1}],6)+0.0 AS upper FROM vals""")
def permutation_test_mi(spark, sf):
    bins, y, _ = binned_train(spark, sf)
    rows = bins.filter("feature = 'qty_exp' AND bin IS NOT NULL").join(y, "row_id").select("row_id", "bin", "y")
    j = information.permuted_pairs(materialize(rows), "row_id", "bin", "y", _NPERM, 1)
    mi = information.mutual_information(j, ["perm"])
    out = information.permutation_interval(mi, "mi", _NPERM)
    return out.select(r6(F.col("mean"), "mean"), r6(F.col("lower"), "lower"), r6(F.col("upper"), "upper"))


# ---- bootstraps --------------------------------------------------------------

_BOOT = f"""posn AS (SELECT row_id, row_number() OVER (ORDER BY md5('5:pos:'||row_id), row_id) - 1 AS k, count(*) OVER () AS n FROM train),
 draw AS (SELECT run, {S.h("'5:'||run||':'||k")} % n AS k FROM posn, (SELECT unnest(range(0,3)) AS run)),
 boot AS (SELECT CAST(run AS INTEGER) AS run, row_id, w FROM (SELECT run, k, count(*) AS w FROM draw GROUP BY ALL) JOIN posn USING (k))"""


@q("bootstrap_weights", TRAIN + "," + _BOOT + "SELECT run, row_id, w FROM boot")
def bootstrap_weights(spark, sf):
    return stability.bootstrap_weights(train_part(spark, sf).filter("split = 'train'").select("row_id"), "row_id", 3, 5)


_BOOT_BINS = TRAIN_LONG + DICT + "," + _BOOT + """, bl AS (SELECT run, row_id, feature, value, unnest(range(0, w)) AS copy FROM lng JOIN boot USING (row_id)), """ + \
    S.quantile_bins("bl", 10, "run, feature") + "," + S.binned("bl", ids="row_id, copy", by="run, feature") + target_cte() + \
    ", jy AS (SELECT run, feature, bin AS x, y FROM binned b JOIN y ON b.row_id=y.row_id)," + \
    ",\n".join([ent("hx", "jy", ["run", "feature"], ["x"]), ent("hy", "jy", ["run", "feature"], ["y"]), ent("hxy", "jy", ["run", "feature"], ["x", "y"])]) + """,
 sel AS (SELECT run, feature, mi, rank FROM (SELECT run, feature, mi, row_number() OVER (PARTITION BY run ORDER BY round(mi,10) DESC, pos) AS rank FROM
   (SELECT run, feature, pos, greatest(hx.h+hy.h-hxy.h,0) AS mi FROM hx JOIN hy USING (run, feature) JOIN hxy USING (run, feature) JOIN dict USING (feature))) WHERE rank <= 5)"""


def _boot_picks(spark, sf, method="MIM", k=5):
    train = materialize(train_part(spark, sf).filter("split = 'train'").select(*IDS, *S.FULL))
    y = preprocess.discretize_target(train.select("row_id", "os_time"), "os_time", "discrete").select("row_id", "y")
    return stability.supervised_screen(train, S.FULL, y, method, k, 10, 3, seed=5)


@q("select_on_bootstraps", _BOOT_BINS + "SELECT run, feature, CAST(rank AS INTEGER) AS rank, round(mi,6)+0.0 AS mi FROM sel")
def select_on_bootstraps(spark, sf):
    t = information.selection_table(spark, _boot_picks(spark, sf), "run")
    return t.select("run", "feature", "rank", r6(F.col("mi"), "mi"))


@q("stability_select", _BOOT_BINS + """SELECT feature, times, row_number() OVER (ORDER BY times DESC, feature) AS rank FROM
 (SELECT feature, count(*) AS times FROM sel GROUP BY feature HAVING count(*) >= 2 ORDER BY times DESC, feature LIMIT 5)""")
def stability_select(spark, sf):
    t = information.selection_table(spark, _boot_picks(spark, sf), "run")
    return stability.stability_select(t, 2, 5)


@q("supervised_dispatch", TRAIN_LONG + DICT + "," + S.quantile_bins("lng", 10) + "," + S.binned("lng") + target_cte() + "," + _RHO + """
SELECT feature, round(rho,6)+0.0 AS rho, CAST(rank AS INTEGER) AS rank FROM
 (SELECT feature, rho, row_number() OVER (ORDER BY round(abs(rho),10) DESC NULLS LAST, pos) AS rank FROM rho JOIN dict USING (feature)) WHERE rank <= 4""")
def supervised_dispatch(spark, sf):
    train = materialize(train_part(spark, sf).filter("split = 'train'").select(*IDS, *S.FULL))
    y = preprocess.discretize_target(train.select("row_id", "os_time"), "os_time", "discrete").select("row_id", "y")
    picks = stability.supervised_screen(train, S.FULL, y, "CORR", 4, 10, 0)
    rows = [(p["feature"], p["score"], p["rank"]) for p in picks]
    return spark.createDataFrame(rows, "feature string, rho double, rank int").select("feature", r6(F.col("rho"), "rho"), "rank")
