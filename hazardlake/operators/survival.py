"""Survival curves, risk-set sums and baseline hazards.

Rows are first summed to one row per distinct time, then suffix or prefix sums
run over times in value ranges; no window ever covers raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardlake.functions.ordered import exact_quantiles, join_null_safe, running_totals
from hazardlake.session import materialize


def event_table(df: DataFrame, event: str, time: str, keys: Sequence[str] = ()) -> DataFrame:
    """Events, censored and at-risk counts at every distinct time."""
    t = df.groupBy(*keys, F.col(time).alias("time")).agg(
        F.sum(F.col(event).cast("bigint")).alias("d"), F.count(F.lit(1)).alias("m")
    )
    run = running_totals(t, keys, "time", ["m"])
    at_risk = F.col("m_all") - F.col("m_upto") + F.col("m")
    return run.select(*keys, "time", F.col("d").alias("events"), (F.col("m") - F.col("d")).alias("censored"), at_risk.alias("at_risk"))


def kaplan_meier(df: DataFrame, event: str, time: str, keys: Sequence[str] = ()) -> DataFrame:
    """Product-limit survival at every distinct time.

    Survival only falls at event times, so the product is a running sum of
    log(1 - d/n) and a running count of zero factors (d = n).
    """
    t = event_table(df, event, time, keys)
    step = F.when(F.col("events") < F.col("at_risk"), F.log1p(-F.col("events") / F.col("at_risk"))).otherwise(0.0)
    t = t.withColumn("_log", step).withColumn("_zero", (F.col("events") == F.col("at_risk")).cast("bigint"))
    run = running_totals(materialize(t), keys, "time", ["_log", "_zero"])
    surv = F.when(F.col("_zero_upto") > 0, 0.0).otherwise(F.exp("_log_upto"))
    return run.select(*keys, "time", "events", "censored", "at_risk", surv.alias("survival"))


def at_risk_counts(df: DataFrame, event: str, time: str, at: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """At risk, and events and censored so far, at the requested times.

    One pass with a few conditional sums per requested time.
    """
    pts = F.array(*[
        F.struct(
            F.lit(float(a)).alias("time"),
            F.count(F.when(F.col(time) >= a, 1)).alias("at_risk"),
            F.count(F.when((F.col(time) <= a) & (F.col(event) == 1), 1)).alias("events"),
            F.count(F.when((F.col(time) <= a) & (F.col(event) == 0), 1)).alias("censored"),
        )
        for a in at
    ])
    one = df.groupBy(*keys).agg(pts.alias("_p"))
    return one.select(*keys, F.inline("_p"))


def risk_set_sums(
    df: DataFrame, event: str, time: str, eta: Column | float, x: Sequence[str] = (), keys: Sequence[str] = ()
) -> DataFrame:
    """At each time: events ``d``, and sums of e^eta and x*e^eta over rows still at risk."""
    w = F.exp(eta if isinstance(eta, Column) else F.lit(float(eta)))
    cols = {"s0": w} | {f"s1_{c}": w * F.col(c) for c in x}
    t = df.groupBy(*keys, F.col(time).alias("time")).agg(
        F.sum(F.col(event).cast("bigint")).alias("d"), *[F.sum(c).alias(n) for n, c in cols.items()]
    )
    run = running_totals(t, keys, "time", list(cols))
    return run.select(
        *keys, "time", "d", *[(F.col(f"{n}_all") - F.col(f"{n}_upto") + F.col(n)).alias(n) for n in cols]
    )


def cumulative_hazard(sums: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Breslow cumulative baseline hazard ``(keys, time, hazard)`` from risk-set sums."""
    step = sums.select(*keys, "time", F.when(F.col("d") > 0, F.col("d") / F.col("s0")).otherwise(0.0).alias("h"))
    return running_totals(materialize(step), keys, "time", ["h"]).select(*keys, "time", F.col("h_upto").alias("hazard"))


def baseline_hazard(df: DataFrame, event: str, time: str, eta: Column, keys: Sequence[str] = ()) -> DataFrame:
    return cumulative_hazard(risk_set_sums(df, event, time, eta, keys=keys), keys)


def lookup_steps(points: DataFrame, steps: DataFrame, at: str, keys: Sequence[str], step_time: str, values: Sequence[str]) -> DataFrame:
    """As-of join: for each point the last step with ``step_time`` <= ``at``.

    Points and steps are merged per distinct time; "last value so far" is found
    inside value ranges, with the range's entry value carried over.
    """
    keys = list(keys)
    val = F.struct(*values)
    ev = steps.groupBy(*keys, F.col(step_time).alias("_t")).agg(F.max(val).alias("_s"))
    pt = points.select(*keys, F.col(at).alias("_t"))
    m = ev.select(*keys, "_t", F.lit(1).cast("bigint").alias("_k")).unionByName(pt.select(*keys, "_t", F.lit(0).cast("bigint").alias("_k")))
    m = materialize(m.groupBy(*keys, "_t").agg(F.max("_k").alias("_k")))
    ev = materialize(ev)
    run = running_totals(m, keys, "_t", ["_k"])  # number of steps so far identifies the last one
    num = running_totals(ev.select(*keys, "_t", F.lit(1).cast("bigint").alias("_k")), keys, "_t", ["_k"]).select(*keys, "_t", F.col("_k_upto").alias("_no"))
    numbered = join_null_safe(ev, num, [*keys, "_t"]).select(*keys, "_no", "_s")
    reached = run.select(*keys, F.col("_t").alias(at), F.col("_k_upto").alias("_no"))
    found = join_null_safe(reached, numbered, [*keys, "_no"], "left")
    return join_null_safe(points, found.select(*keys, at, *[F.col(f"_s.{v}").alias(v) for v in values]), [*keys, at], "left")


def predict_survival(
    rows: DataFrame, hazard: DataFrame, at: Sequence[float], eta: Column, keys: Sequence[str] = ()
) -> DataFrame:
    """S(t|x) = exp(-H0(t) e^eta) per row for the requested times.

    Only the requested points of the step function travel to the rows: one
    aggregate over the hazard table with an entry per requested time.
    """
    h0 = [F.coalesce(F.max(F.when(F.col("time") <= a, F.col("hazard"))), F.lit(0.0)) for a in at]
    pts = F.array(*[F.struct(F.lit(float(a)).alias("time"), h.alias("h0")) for a, h in zip(at, h0)])
    table = hazard.groupBy(*keys).agg(pts.alias("_p"))
    joined = join_null_safe(rows, table, keys) if keys else rows.withColumn("_p", table.scalar())
    out = joined.withColumn("_q", F.explode("_p"))
    return out.select(*rows.columns, F.col("_q.time").alias("time"), F.exp(-F.col("_q.h0") * F.exp(eta)).alias("survival"))


def box_stats(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Five-number summary per series."""
    q = exact_quantiles(df, keys, value, [0.0, 0.25, 0.5, 0.75, 1.0])
    names = ["low", "q1", "median", "q3", "high"]
    return q.select(*keys, *[F.col("quantiles")[i].alias(n) for i, n in enumerate(names)])
