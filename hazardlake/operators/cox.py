"""Cox models fitted by Spark passes, many models at a time.

Rows are ``(id, os, os_time, x array<double>[, fold])``.  A batch of models
(penalties x folds) shares every pass; single-feature models are in `coxscreen`.
One pass sums e^eta per distinct time, a second one, knowing the cumulative
baseline hazard H0, sums x (event - e^eta H0), which is the gradient of the
Breslow partial likelihood, and x x' e^eta H0, a bound on its curvature.  The
driver holds coefficients and p x p systems only.

With few distinct times (``MAX_TIME_CELLS`` models x times) the rows are packed into
slabs once, the time sums travel to the driver and H0 back by broadcast.  Beyond that they stay a table: suffix
sums run in Spark and H0 is joined to the rows by time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlake.functions.gram import pack_rows, slabs, sum_vectors, to_numpy
from hazardlake.functions.ordered import running_totals
from hazardlake.session import materialize

MAX_TIME_CELLS = 1 << 19
RIDGE_ALPHAS = tuple(float(a) for a in 10.0 ** np.linspace(-4, 4, 10))
NET_L1_RATIOS = (1e-16, 0.25, 0.5, 0.75, 1.0)
NET_MIN_RATIOS = (0.0001, 0.001, 0.01, 0.1)


def _eta(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return np.clip(np.nan_to_num(x, nan=0.0) @ beta.T, -500, 500)


def _mask(b: dict, x: np.ndarray, held_out: np.ndarray) -> np.ndarray:
    """Which rows each model sees: not its held-out fold."""
    m = np.ones((len(x), len(held_out)))
    if (held_out >= 0).any():
        m *= b["fold"][:, None] != held_out[None, :]
    return m


def _add_rows(out: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """Add row i of ``values`` to row at[i] of ``out``, which is contiguous."""
    m = out.shape[1]
    np.add.at(out.reshape(-1), (at.astype(np.int64)[:, None] * m + np.arange(m)).ravel(), values.ravel())


@dataclass
class CoxProblem:
    """The passes over one training table for a batch of models.

    ``rows`` without ``extra`` columns are packed where the time sums fit the driver; others stay as they are.
    With ``centered`` the mean of every column is taken off.
    """

    rows: DataFrame
    n_features: int
    held_out: Sequence[int] = (-1,)
    max_time_cells: int = MAX_TIME_CELLS
    extra: Sequence[str] = ()
    centered: bool = False
    times: np.ndarray | None = field(default=None, init=False)
    packed: DataFrame | None = field(default=None, init=False)
    center: np.ndarray | None = field(default=None, init=False)

    def __post_init__(self):
        cols = ["os", "os_time", "x", *self.extra] + (["fold"] if "fold" in self.rows.columns else [])
        self.rows = self.rows.select(*cols).filter("os IS NOT NULL AND os_time IS NOT NULL")
        if self.extra:
            self.rows = materialize(self.rows)
        self.held_out = np.asarray(self.held_out)
        m = len(self.held_out)
        self.center = np.zeros(self.n_features)
        limit = self.max_time_cells // m
        found = self.rows.select("os_time").distinct().limit(limit + 1).collect()  # one number per time
        if len(found) <= limit:
            self.times = np.sort(np.array([r[0] for r in found], dtype=float))
        if self.extra:
            return
        if self.on_driver:
            times = self.times
            self.packed = materialize(pack_rows(self.rows, lambda t: np.searchsorted(times, t)))
            if self.centered:
                self.center = self._means()
        else:
            if self.centered:
                self.center = feature_means(self.rows, self.n_features)
            self.rows = materialize(_centered(self.rows, self.center) if self.centered else self.rows)

    def _means(self) -> np.ndarray:
        p = self.n_features

        def partial(batches):
            total = np.zeros(p + 1)
            for b in batches:
                total += np.append(np.nan_to_num(b["x"], nan=0.0).sum(axis=0), len(b["x"]))
            return range(1), [total]

        total = np.zeros(p + 1)
        for r in sum_vectors(self.packed, partial, slabs).collect():  # one row
            total = np.asarray(r["v"])
        return total[:p] / max(total[p], 1.0)

    def sum_rows(self, partial, rows: DataFrame | None = None) -> DataFrame:
        """`sum_vectors` over the packed rows, or over ``rows``; batches carry ``at``, the number of the time, where times are on the driver."""
        if self.packed is not None:
            center = self.center

            def read(batch):
                for b in slabs(batch):
                    yield b | {"x": b["x"] - center} if center.any() else b

            return sum_vectors(self.packed, partial, read)
        times = self.times

        def timed(batches):
            return partial(b if times is None else b | {"at": np.searchsorted(times, b["os_time"])} for b in batches)

        return sum_vectors(self.rows if rows is None else rows, timed)

    def seen(self) -> np.ndarray:
        """Rows that every model sees."""
        held = self.held_out
        partial = lambda batches: (range(1), [sum((_mask(b, b["x"], held).sum(axis=0) for b in batches), np.zeros(len(held)))])
        out = np.zeros(len(held))
        for r in self.sum_rows(partial).collect():  # one row
            out = np.asarray(r["v"])
        return out

    @property
    def on_driver(self) -> bool:
        return self.times is not None

    def _partial_time_sums(self, eta_of):
        n_times, held = len(self.times), self.held_out

        def partial(batches):
            m = len(held)
            s0, d, lin = np.zeros((n_times, m)), np.zeros((n_times, m)), np.zeros(m)
            for b in batches:
                x = b["x"]
                eta, seen = eta_of(b), _mask(b, x, held)
                ev = seen * b["os"][:, None]
                _add_rows(s0, b["at"], np.exp(eta) * seen)
                _add_rows(d, b["at"], ev)
                lin += (ev * eta).sum(axis=0)
            return range(m), [np.concatenate([s0[:, j], d[:, j], lin[j : j + 1]]) for j in range(m)]

        return partial

    def hazards(self, beta: np.ndarray):
        """`hazards_of` a linear predictor per model."""
        return self.hazards_of(lambda b: _eta(b["x"], beta))

    def hazards_of(self, eta_of):
        """(log-likelihood per model, H0): H0 as a matrix or as a table. ``eta_of`` gives rows x models for a batch."""
        m = len(self.held_out)
        if self.on_driver:
            t = len(self.times)
            s0, d, lin = np.zeros((t, m)), np.zeros((t, m)), np.zeros(m)
            for r in self.sum_rows(self._partial_time_sums(eta_of)).collect():  # one vector per model
                v = np.asarray(r["v"])
                s0[:, r["k"]], d[:, r["k"]], lin[r["k"]] = v[:t], v[t : 2 * t], v[2 * t]
            risk = np.cumsum(s0[::-1], axis=0)[::-1]
            step = np.where(d > 0, d / np.where(d > 0, risk, 1.0), 0.0)
            loglik = lin - np.where(d > 0, d * np.log(np.where(d > 0, risk, 1.0)), 0.0).sum(axis=0)
            return loglik, np.cumsum(step, axis=0)
        return self._hazard_table(eta_of)

    def _hazard_table(self, eta_of):
        held = self.held_out

        def sums(batches):
            for rb in batches:
                if not rb.num_rows:
                    continue
                b = to_numpy(rb)
                x = b["x"]
                eta, seen = eta_of(b), _mask(b, x, held)
                times, at = np.unique(b["os_time"], return_inverse=True)
                ev = seen * b["os"][:, None]
                out = np.zeros((3, len(times), len(held)))
                for o, v in zip(out, (np.exp(eta) * seen, ev, ev * eta)):
                    np.add.at(o, at, v)
                model = np.tile(np.arange(len(held)), len(times))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(model.astype(np.int32)), pa.array(np.repeat(times, len(held)))] + [pa.array(o.ravel()) for o in out],
                    names=["model", "time", "s0", "d", "lin"],
                )

        t = self.rows.mapInArrow(sums, "model int, time double, s0 double, d double, lin double")
        t = materialize(t.groupBy("model", "time").agg(*[F.sum(c).alias(c) for c in ("s0", "d", "lin")]))
        run = running_totals(t, ["model"], "time", ["s0"])
        risk = F.col("s0_all") - F.col("s0_upto") + F.col("s0")
        at_event = F.col("d") > 0
        steps = materialize(
            run.select(
                "model", "time", F.when(at_event, F.col("d") / risk).otherwise(0.0).alias("h"),
                (F.col("lin") - F.when(at_event, F.col("d") * F.log(risk)).otherwise(0.0)).alias("ll"),
            )
        )
        loglik = np.zeros(len(held))
        for r in steps.groupBy("model").agg(F.sum("ll").alias("ll")).collect():
            loglik[r["model"]] = r["ll"]
        h0 = running_totals(steps, ["model"], "time", ["h"])
        # every model has every time, so the sorted list is the models in order
        table = h0.groupBy("time").agg(F.transform(F.sort_array(F.collect_list(F.struct("model", "h_upto"))), lambda s: s["h_upto"]).alias("h0"))
        return loglik, materialize(table)

    def gradients(self, beta: np.ndarray, h0, curvature: str = "full", active: Sequence[np.ndarray] | None = None):
        """Gradient (m x p) and curvature bound: p x p per model, its diagonal, or (``active``) that of each model's columns."""
        m, p = len(self.held_out), self.n_features
        if active is not None:
            return self._active_gradients(beta, h0, active)
        held = self.held_out
        sc = self.rows.sparkSession.sparkContext
        sent = sc.broadcast(h0) if self.on_driver else None
        rows = self.rows if self.on_driver else self.rows.join(h0.withColumnRenamed("time", "os_time"), "os_time")

        def partial(batches):
            grad = np.zeros((m, p))
            curv = np.zeros((m, p, p)) if curvature == "full" else np.zeros((m, p))
            for b in batches:
                x = b["x"]
                eta, seen = _eta(x, beta), _mask(b, x, held)
                base = sent.value[b["at"]] if sent is not None else b["h0"]
                w = np.exp(eta) * base * seen
                res = seen * b["os"][:, None] - w
                x = np.nan_to_num(x, nan=0.0)
                grad += res.T @ x
                if curvature == "full":
                    for j in range(m):
                        curv[j] += x.T @ (x * w[:, j : j + 1])
                else:
                    curv += w.T @ (x * x)
            return range(m), [np.concatenate([grad[j], curv[j].ravel()]) for j in range(m)]

        grad = np.zeros((m, p))
        full = curvature == "full"
        curv = np.zeros((m, p, p)) if full else np.zeros((m, p))
        for r in self.sum_rows(partial, rows).collect():  # one vector per model
            v = np.asarray(r["v"])
            grad[r["k"]] = v[:p]
            curv[r["k"]] = v[p:].reshape(p, p) if full else v[p:]
        if sent is not None:
            sent.destroy()
        return grad, curv

    def _active_gradients(self, beta: np.ndarray, h0, active: Sequence[np.ndarray]):
        """Gradient over all columns, curvature bound over the active ones of each model only."""
        m, p, held = len(self.held_out), self.n_features, self.held_out
        sent = self.rows.sparkSession.sparkContext.broadcast(h0) if self.on_driver else None
        rows = self.rows if self.on_driver else self.rows.join(h0.withColumnRenamed("time", "os_time"), "os_time")

        def partial(batches):
            grad, curv = np.zeros((m, p)), [np.zeros((len(c), len(c))) for c in active]
            for b in batches:
                x = np.nan_to_num(b["x"], nan=0.0)
                base = sent.value[b["at"]] if sent is not None else b["h0"]
                seen = _mask(b, x, held)
                w = np.exp(_eta(x, beta)) * base * seen
                grad += (seen * b["os"][:, None] - w).T @ x
                for j, c in enumerate(active):
                    part = x[:, c]
                    curv[j] += part.T @ (part * w[:, j : j + 1])
            return range(m), [np.concatenate([grad[j], curv[j].ravel()]) for j in range(m)]

        grad, curv = np.zeros((m, p)), [np.zeros((len(c), len(c))) for c in active]
        for r in self.sum_rows(partial, rows).collect():  # one vector per model
            v, k = np.asarray(r["v"]), r["k"]
            grad[k], curv[k] = v[:p], v[p:].reshape(curv[k].shape)
        if sent is not None:
            sent.destroy()
        return grad, curv


@dataclass
class CoxModel:
    features: list[str]
    coef: np.ndarray
    center: np.ndarray
    loglik: float
    iterations: int = 0
    gradient: np.ndarray | None = None

    def eta(self, x: str = "x"):
        """Linear predictor as a column expression."""
        beta = F.array(*[F.lit(float(b)) for b in self.coef])
        shift = float(self.coef @ self.center)
        prod = F.zip_with(F.col(x), beta, lambda a, b: a * b)
        return F.aggregate(prod, F.lit(0.0), lambda s, v: s + v) - F.lit(shift)


def feature_means(rows: DataFrame, p: int) -> np.ndarray:
    out = np.zeros(p)
    m = rows.select(F.posexplode("x").alias("i", "v")).filter(F.col("v").isNotNull()).groupBy("i").agg(F.avg("v").alias("m"))
    for r in m.collect():  # one row per feature
        out[r["i"]] = r["m"]
    return out


def check_complete(rows: DataFrame) -> None:
    """Models need every value: a missing one must be imputed or its row dropped before."""
    gap = F.col("x").isNull() | F.exists("x", lambda v: v.isNull() | F.isnan(v))
    n = rows.filter(gap | F.col("os").isNull() | F.col("os_time").isNull()).count()
    if n:
        raise ValueError(f"{n} rows have missing features, event or time")


def _centered(rows: DataFrame, center: np.ndarray) -> DataFrame:
    c = F.array(*[F.lit(float(v)) for v in center])
    return rows.withColumn("x", F.zip_with(F.col("x"), c, lambda a, b: a - b))


def fit_ridge(
    rows: DataFrame,
    features: Sequence[str],
    alphas: Sequence[float] = (1.0,),
    held_out: Sequence[int] | None = None,
    max_iter: int = 30,
    tol: float = 1e-9,
    max_time_cells: int = MAX_TIME_CELLS,
) -> list[CoxModel]:
    """Minimise -loglik + alpha/2 |b|^2 (Breslow ties) for every (alpha, fold).

    Steps solve (X'WX + alpha I) s = gradient on centred features; a step that
    lowers the objective is halved.  X must have no missing values.
    """
    p, m = len(features), len(alphas)
    check_complete(rows)
    prob = CoxProblem(rows, p, held_out or [-1] * m, max_time_cells=max_time_cells, centered=True)
    a = np.asarray(alphas, dtype=float)
    beta, step = np.zeros((m, p)), np.zeros((m, p))
    best = np.full(m, -np.inf)
    kept, grad_out = beta.copy(), np.zeros((m, p))
    done = np.zeros(m, dtype=bool)
    it = 0
    for it in range(1, max_iter + 1):
        loglik, h0 = prob.hazards(beta)
        value = loglik - 0.5 * a * (beta**2).sum(axis=1)
        worse = (value < best - 1e-10 * np.abs(best)) & ~done
        grad, curv = prob.gradients(beta, h0)
        for j in range(m):
            if done[j]:
                continue
            if worse[j]:
                step[j] /= 2
                beta[j] = kept[j] + step[j]
                continue
            gain = value[j] - best[j]
            kept[j], best[j] = beta[j], value[j]
            g = grad[j] - a[j] * beta[j]
            grad_out[j] = g
            s = np.linalg.lstsq(curv[j] + a[j] * np.eye(p), g, rcond=1e-12)[0]
            if gain < tol * (abs(value[j]) + 1) or float(g @ s) < tol:
                done[j] = True
                continue
            step[j] = s
            beta[j] = kept[j] + s
        if done.all():
            break
    return [CoxModel(list(features), kept[j], prob.center, float(best[j] + 0.5 * a[j] * (kept[j] ** 2).sum()), it, grad_out[j]) for j in range(m)]


def _net_step(curv, grad, beta, n, l1, l2, sweeps=200, tol=1e-10):
    """Coordinate descent on the quadratic model of -loglik/n plus the penalty."""
    b = beta.copy()
    h, g0 = curv / n, grad / n
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(b)):
            if h[j, j] <= 0:
                continue
            r = g0[j] - h[j] @ (b - beta) + h[j, j] * b[j]
            new = np.sign(r) * max(abs(r) - l1, 0.0) / (h[j, j] + l2)
            moved = max(moved, abs(new - b[j]))
            b[j] = new
        if moved < tol:
            break
    return b


def fit_elastic_net(
    rows: DataFrame,
    features: Sequence[str],
    configs: Sequence[tuple[float, float]] = ((0.5, 0.01),),
    held_out: Sequence[int] | None = None,
    n_alphas: int = 100,
    inner: int = 3,
    max_time_cells: int = MAX_TIME_CELLS,
    final: int = 100,
    tol: float = 1e-9,
) -> list[CoxModel]:
    """Minimise -loglik/n + alpha (l1 |b|_1 + (1-l1)/2 |b|^2) down a path of alphas.

    ``configs`` are (l1_ratio, alpha_min_ratio); the path runs from the smallest alpha with b = 0 to
    alpha_min_ratio times it, warm started, and the model at its end is returned. All configurations and
    folds advance together. A step works on active columns: those in the model and those that the
    strong rule keeps (|gradient|/n >= l1 (2 alpha - previous alpha)); only their curvature is gathered.
    Gradients cover all columns, so a column that breaks its optimality condition is found and joins. A
    step takes ``inner`` rounds at most, the last one goes on (``final``) until coefficients move less than
    ``tol`` and no condition is broken. ``gradient`` of a model holds the distance of every column from its condition.
    """
    p, m = len(features), len(configs)
    check_complete(rows)
    prob = CoxProblem(rows, p, held_out or [-1] * m, max_time_cells=max_time_cells, centered=True)
    n = prob.seen()
    l1r, ratios = np.array([c[0] for c in configs]), np.array([c[1] for c in configs])
    beta = np.zeros((m, p))
    none = [np.zeros(0, np.int64)] * m
    loglik, h0 = prob.hazards(beta)
    grad, _ = prob.gradients(beta, h0, active=none)
    top = np.abs(grad).max(axis=1) / n / np.maximum(l1r, 1e-3)
    before = top
    active = none
    for step in range(n_alphas):
        alpha = top * ratios ** (step / max(1, n_alphas - 1))
        l1, l2 = alpha * l1r, alpha * (1 - l1r)
        kept = [np.flatnonzero((np.abs(grad[j]) / n[j] >= l1r[j] * (2 * alpha[j] - before[j])) | (beta[j] != 0)) for j in range(m)]
        kept = [np.union1d(a, b) for a, b in zip(active, kept)]
        for _ in range(inner if step + 1 < n_alphas else final):
            if any(len(a) != len(b) for a, b in zip(active, kept)) or step == 0:
                active = kept
                grad, curv = prob.gradients(beta, h0, active=active)
            new = beta.copy()
            for j, c in enumerate(active):
                if len(c):
                    new[j, c] = _net_step(curv[j], grad[j, c], beta[j, c], n[j], l1[j], l2[j])
            change = np.abs(new - beta).max() if m else 0.0
            beta = new
            loglik, h0 = prob.hazards(beta)
            grad, curv = prob.gradients(beta, h0, active=active)
            broken = [np.flatnonzero((np.abs(grad[j]) / n[j] > l1[j] * (1 + 1e-9)) & (beta[j] == 0)) for j in range(m)]
            kept = [np.union1d(a, b).astype(np.int64) for a, b in zip(active, broken)]
            if change < tol and all(len(a) == len(b) for a, b in zip(active, kept)):
                break
        before = alpha
    alpha = top * ratios
    # distance from the optimality conditions, 0 at the solution
    slack = grad / n[:, None] - (alpha * (1 - l1r))[:, None] * beta
    kkt = np.where(beta != 0, np.abs(slack - (alpha * l1r)[:, None] * np.sign(beta)), np.maximum(np.abs(slack) - (alpha * l1r)[:, None], 0))
    return [CoxModel(list(features), beta[j], prob.center, float(loglik[j]), n_alphas, kkt[j]) for j in range(m)]
