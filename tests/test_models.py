import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardlake.operators import boosting, cox, forest, modelling, survival, treeboost
from hazardlake.operators.concordance import concordance_index
from hazardlake.session import materialize


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    n = 900
    x = rng.normal(size=(n, 3))
    t = rng.exponential(np.exp(-0.8 * x[:, 0] - 1.2 * (x[:, 1] > 0.3)))
    c = rng.exponential(1.5, n)
    rows = [
        (i, "test" if i % 4 == 0 else "train", "t", int(t[i] <= c[i]), float(np.ceil(min(t[i], c[i]) * 40)), [float(v) for v in x[i]], i % 3)
        for i in range(n)
    ]
    return materialize(spark.createDataFrame(rows, "row_id bigint, split string, type string, os int, os_time double, x array<double>, fold int"))


F3 = ["a", "b", "c"]


def loglik(pdf, beta):
    x, t, e = np.stack(pdf["x"]), pdf["os_time"].to_numpy(), pdf["os"].to_numpy()
    eta = x @ beta
    return sum(eta[i] - np.log(np.exp(eta[t >= t[i]]).sum()) for i in np.flatnonzero(e))


def test_ridge_optimum_on_both_paths(spark, data):
    train = data.filter("split = 'train'")
    one, two = cox.fit_ridge(train, F3, [0.5, 50.0], max_iter=25)
    table = cox.fit_ridge(train, F3, [0.5, 50.0], max_iter=25, max_time_cells=2)
    assert np.allclose(one.coef, table[0].coef) and np.allclose(two.coef, table[1].coef)
    pdf = train.toPandas()
    assert abs(loglik(pdf, one.coef) - one.loglik) < 1e-6
    for j in range(3):
        e = np.eye(3)[j] * 1e-4
        g = (loglik(pdf, one.coef + e) - loglik(pdf, one.coef - e)) / 2e-4 - 0.5 * one.coef[j]
        assert abs(g) < 0.05
    assert np.abs(two.coef).sum() < np.abs(one.coef).sum()


def test_held_out_fold_equals_separate_fit(spark, data):
    train = data.filter("split = 'train'")
    batch = cox.fit_ridge(train, F3, [1.0, 1.0], [0, 2])
    for m, f in zip(batch, (0, 2)):
        alone = cox.fit_ridge(train.filter(F.col("fold") != f), F3, [1.0])[0]
        assert np.allclose(m.coef, alone.coef, atol=1e-4)


def test_elastic_net_conditions(spark, data):
    ms = cox.fit_elastic_net(data.filter("split = 'train'"), F3, [(0.5, 0.01), (1.0, 0.5)], n_alphas=5, inner=8)
    assert all(m.gradient.max() < 1e-4 for m in ms)
    assert (ms[1].coef == 0).sum() > (ms[0].coef == 0).sum() or abs(ms[1].coef).sum() < abs(ms[0].coef).sum()


def test_componentwise_rounds_are_nested(spark, data):
    train = data.filter("split = 'train'")
    ten = boosting.fit_componentwise(train, F3, [(3, 0.8), (6, 0.8)])
    assert ten[1].loglik > ten[0].loglik


def test_tree_models_find_signal(spark, data):
    train = data.filter("split = 'train'")
    boost = treeboost.fit_tree_boost(train, F3, 2, 0.8, 2)
    rsf = forest.fit_forest(train, F3, n_estimators=4, min_samples_split=40, min_samples_leaf=15, max_features=2, max_depth=3)
    for m in (boost, rsf):
        assert concordance_index(m.score(data), "os", "os_time", "risk", ["split"]).agg(F.min("cindex")).first()[0] > 0.65


def test_grid_search_and_evaluation(spark, data):
    wide = data.select("row_id", "split", "type", "os", "os_time", *[F.get("x", F.lit(i)).alias(f) for i, f in enumerate(F3)])
    # shrinkage hardly changes ranks, so only the search's own table tells which penalty wins
    best, table = modelling.grid_search("CPH-L2", data.filter("split = 'train'"), F3, {"alpha": [0.1, 1e6]}, 3)
    scores = {r["config"]: r["cindex"] for r in table.collect()}
    assert best == {"alpha": [0.1, 1e6][max(scores, key=lambda c: (round(scores[c], 10), -c))]}
    t = modelling.train_and_evaluate(wide, F3, "CPH-L2", {"alpha": [0.1]}, importances=True, n_iter=2)
    assert t.config == {"alpha": 0.1} and t.cindex["test"] > 0.6
    assert t.importances.orderBy("rank").first()["feature"] in ("a", "b")
    with pytest.raises(ValueError):
        modelling.train_and_evaluate(wide, F3, "OTHER")


def test_kaplan_meier_by_hand(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 1.0), (1, 2.0), (1, 3.0)], "os int, t double")
    got = [(r["time"], r["at_risk"], round(r["survival"], 6)) for r in survival.kaplan_meier(df, "os", "t").orderBy("time").collect()]
    assert got == [(1.0, 4, 0.75), (2.0, 2, 0.375), (3.0, 1, 0.0)]


def test_step_lookup(spark):
    steps = spark.createDataFrame([("a", 1.0, 10.0), ("a", 3.0, 30.0), ("b", 2.0, 20.0)], "g string, t double, v double")
    pts = spark.createDataFrame([("a", 0.5), ("a", 1.0), ("a", 2.9), ("a", 9.0), ("b", 2.0)], "g string, at double")
    got = {(r["g"], r["at"]): r["v"] for r in survival.lookup_steps(pts, steps, "at", ["g"], "t", ["v"]).collect()}
    assert got == {("a", 0.5): None, ("a", 1.0): 10.0, ("a", 2.9): 10.0, ("a", 9.0): 30.0, ("b", 2.0): 20.0}
