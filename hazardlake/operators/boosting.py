"""Componentwise gradient boosting of the Cox partial likelihood; trees are in `treeboost`."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlake.operators.cox import MAX_TIME_CELLS, CoxModel, CoxProblem, check_complete

N_ESTIMATORS = (10, 50, 100)
LEARNING_RATES = (0.8, 0.9, 1.0)


def fit_componentwise(
    rows: DataFrame,
    features: Sequence[str],
    configs: Sequence[tuple[int, float]] = ((100, 1.0),),
    held_out: Sequence[int] | None = None,
    max_time_cells: int = MAX_TIME_CELLS,
) -> list[CoxModel]:
    """Componentwise least squares; ``configs`` are (rounds, learning rate).

    Each round fits every single column, and a constant, to the martingale
    residuals and adds the best one.  The state is the coefficient vector, so no
    per-row score is carried along.  All configurations share the passes; those
    with fewer rounds stop early.
    """
    m, p = len(configs), len(features)
    check_complete(rows)
    ones = rows.withColumn("x", F.concat(F.array(F.lit(1.0)), F.col("x")))
    prob = CoxProblem(ones, p + 1, held_out or [-1] * m, max_time_cells=max_time_cells)
    held = prob.held_out

    def squares(batches):
        out = np.zeros((m, p + 1))
        for b in batches:
            seen = np.ones((len(b["os"]), m))
            if (held >= 0).any():
                seen *= b["fold"][:, None] != held[None, :]
            out += seen.T @ (b["x"] ** 2)
        return range(m), list(out)

    norm = np.zeros((m, p + 1))
    for r in prob.sum_rows(squares).collect():  # one vector per model
        norm[r["k"]] = r["v"]
    beta = np.zeros((m, p + 1))
    loglik = np.zeros(m)
    for step in range(max(c[0] for c in configs)):
        _, h0 = prob.hazards(beta)
        grad, _ = prob.gradients(beta, h0, curvature="diagonal")
        gain = np.round(np.where(norm > 0, grad**2 / np.where(norm > 0, norm, 1.0), 0.0), 9)
        for j, (rounds, rate) in enumerate(configs):
            if step < rounds:
                best = int(np.argmax(gain[j]))
                beta[j, best] += rate * grad[j, best] / norm[j, best]
    loglik, _ = prob.hazards(beta)
    return [CoxModel(list(features), beta[j, 1:], np.zeros(p), float(loglik[j]), configs[j][0]) for j in range(m)]
