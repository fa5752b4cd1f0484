import uuid

import numpy as np
import pytest

from hazardlake.operators import forest, modelling, treeboost
from hazardlake.operators.concordance import concordance_index
from hazardlake.operators.treeboost import Family
from hazardlake.session import materialize


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 240
    x = np.round(rng.normal(size=(n, 3)), 1)
    t = np.ceil(rng.exponential(np.exp(-x[:, 0] + (x[:, 1] > 0.5))) * 30)
    e = (rng.uniform(size=n) < 0.8).astype(int)
    rows = [(i, int(e[i]), float(t[i]), [float(v) for v in x[i]], i % 3) for i in range(n)]
    return materialize(spark.createDataFrame(rows, "row_id bigint, os int, os_time double, x array<double>, fold int").repartition(3))


def by_hand(pdf, rounds, rate, depth):
    """Boosting with every value as a threshold."""
    x, t, e = np.stack(pdf["x"]), pdf["os_time"].to_numpy(), pdf["os"].to_numpy()
    f, fitted = np.zeros(len(t)), []
    for _ in range(rounds):
        times = np.unique(t)
        h = np.cumsum([e[t == s].sum() / np.exp(f[t >= s]).sum() for s in times])
        r = e - np.exp(f) * h[np.searchsorted(times, t)]

        def grow(at, level):
            best = (0.0, None)
            for k in range(x.shape[1] if level < depth else 0):
                for c in np.unique(x[at, k])[1:]:
                    left = at & (x[:, k] < c)
                    right = at & ~left
                    gain = r[left].sum() ** 2 / left.sum() + r[right].sum() ** 2 / right.sum() - r[at].sum() ** 2 / at.sum()
                    if round(gain, 6) > round(best[0], 6):
                        best = (gain, (k, c, left, right))
            if best[1] is None:
                return {"at": at, "value": r[at].mean()}
            k, c, left, right = best[1]
            return {"k": k, "c": c, "sides": (grow(left, level + 1), grow(right, level + 1))}

        def leaves(node):
            return [node] if "at" in node else leaves(node["sides"][0]) + leaves(node["sides"][1])

        tree = grow(np.ones(len(t), bool), 0)
        for leaf in leaves(tree):
            f[leaf["at"]] += rate * leaf["value"]
        fitted.append(f.copy())
    return fitted


def test_trees_equal_boosting_by_hand(spark, data):
    pdf = data.orderBy("row_id").toPandas()
    for cells in (1 << 19, 2):
        m = treeboost.fit_families(data, list("abc"), [Family(0.5, 2)], 12, n_bins=500, max_time_cells=cells)
        got = m.prefix_scores(data.drop("fold"), [1, 5, 12], {0: None}, "s").orderBy("row_id").toPandas()
        want = by_hand(pdf, 12, 0.5, 2)
        for k, n in enumerate((1, 5, 12)):
            assert np.allclose([s[k] for s in got["s"]], want[n - 1], atol=1e-8), (cells, n)


def test_families_and_folds_are_keys(spark, data, monkeypatch):
    monkeypatch.setattr(treeboost, "CELLS", 3 * 64)  # a portion of one node
    families = [Family(0.5, 2), Family(1.0, 1), Family(0.5, 2, 1)]
    together = treeboost.fit_families(data, list("abc"), families, 3)
    alone = treeboost.fit_families(data.filter("fold <> 1"), list("abc"), [Family(0.5, 2)], 3)
    rows = data.filter("fold = 1")
    s = together.prefix_scores(rows, [2, 3], {0: None, 1: None, 2: 1}, "s").orderBy("row_id").collect()
    a = alone.prefix_scores(rows.drop("fold"), [2, 3], {0: None}, "s").orderBy("row_id").collect()
    # bins are those of all rows, so thresholds may differ a little
    assert np.corrcoef([r.s[5] for r in s], [r.s[1] for r in a])[0, 1] > 0.95
    other = together.prefix_scores(data.filter("fold = 0"), [3], {2: 1}, "s").collect()
    assert all(r.s == [None] for r in other)
    assert {t.feature[0] for trees in together.rounds for t in trees} <= {0, 1}


def jobs(spark, run):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "count")
    run()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("rest", "rest")
    return n


@pytest.mark.parametrize("model, one, more, options", [
    ("CPH-GB", {"n_estimators": [3], "learning_rate": [0.8], "max_depth": [1]}, {"n_estimators": [1, 2, 3], "learning_rate": [0.8, 1.0], "max_depth": [1]}, {"n_bins": 8}),
    ("RSF", {"n_estimators": [4], "min_samples_split": [20], "min_samples_leaf": [5], "max_features": ["sqrt"]},
     {"n_estimators": [1, 2, 4], "min_samples_split": [20, 60], "min_samples_leaf": [5, 10], "max_features": ["sqrt"]}, {}),
])
def test_jobs_do_not_grow_with_the_grid(spark, data, model, one, more, options):
    small = jobs(spark, lambda: modelling.grid_search(model, data, list("abc"), one, 3, options))
    large = jobs(spark, lambda: modelling.grid_search(model, data, list("abc"), more, 3, options))
    assert large <= small + 2


def test_grid_scores_equal_single_fits(spark, data):
    grid = {"n_estimators": [1, 2], "min_samples_split": [60], "min_samples_leaf": [5], "max_features": [2]}
    best, table = modelling.grid_search("RSF", data, list("abc"), grid, 3)
    got = {r.config: r.cindex for r in table.collect()}
    for c, config in enumerate(modelling.expand_grid(grid)):
        means = []
        for f in range(3):
            fit = forest.Fit(config["min_samples_split"], config["min_samples_leaf"], f)
            m = forest.fit_forests(data, list("abc"), [fit], config["n_estimators"], 2)
            out = m.score(data.drop("fold").join(data.select("row_id", "fold"), "row_id").filter(f"fold = {f}").drop("fold"))
            means.append(concordance_index(out, "os", "os_time", "risk").first()["cindex"])
        assert abs(got[c] - np.mean(means)) < 1e-9
    assert got[modelling.expand_grid(grid).index(best)] == max(got.values())
