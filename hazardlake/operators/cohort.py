"""Row filters, cohort membership and reproducible splits.

Random order is md5(seed:id), so a split is the same on any cluster, whatever
the partitioning, and can be recomputed in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlake.functions.ordered import exact_quantiles, hash_int, hash_rank, join_null_safe, running_totals, seeded_text


def filter_types(
    df: DataFrame, types: Sequence[str], type_col: str = "type", all_types: Sequence[str] | None = None
) -> DataFrame:
    """Rows of the named groups; ``["ALL"]`` means ``all_types`` or no filter."""
    if list(types) == ["ALL"]:
        if all_types is None:
            return df
        types = all_types
    return df.filter(F.col(type_col).isin(list(types)))


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a value in every one of ``columns``."""
    return df.dropna(subset=list(columns)) if columns else df


def cohort_members(
    df: DataFrame, cohort: DataFrame, attrs: Sequence[str], label: str | None = None, label_col: str = "cohort"
) -> DataFrame:
    """Rows whose attributes appear in the cohort table (under ``label``)."""
    if label is not None:
        cohort = cohort.filter(F.col(label_col) == label)
    return df.join(cohort.select(*attrs), list(attrs), "left_semi")


def rows_not_in(df: DataFrame, taken: DataFrame, id_col: str) -> DataFrame:
    return df.join(taken.select(id_col), id_col, "left_anti")


def _mark(df: DataFrame, train_rank: F.Column, out: str) -> DataFrame:
    part = F.when(F.col("_rank") <= train_rank, "train").otherwise("test")
    return df.withColumn(out, part).drop("_rank", "_total")


def split_rows(
    df: DataFrame, id_col: str, fraction: float, seed, keys: Sequence[str] = (), out: str = "split"
) -> DataFrame:
    """Random row split; the test part has ceil((1 - fraction) * n) rows."""
    ranked = hash_rank(df, id_col, seed, keys, "_rank", "_total")
    n_test = F.ceil(F.lit(1.0 - fraction) * F.col("_total"))
    return _mark(ranked, F.col("_total") - n_test, out)


def split_subjects(
    df: DataFrame, subject_col: str, fraction: float, seed, keys: Sequence[str] = (), out: str = "split"
) -> DataFrame:
    """Split of distinct subjects; the first int(fraction * m) are train.

    Rows without a subject are one more subject: they stay together.
    """
    subjects = df.select(*keys, subject_col).distinct()
    ranked = hash_rank(subjects, subject_col, seed, keys, "_rank", "_total")
    marked = _mark(ranked, F.floor(F.lit(fraction) * F.col("_total")), out)
    return join_null_safe(df, marked, [*keys, subject_col])


def split_stratified(
    df: DataFrame, id_col: str, strata: Sequence[str], fraction: float, seed, keys: Sequence[str] = (),
    out: str = "split",
) -> DataFrame:
    """round(fraction * n_s) rows of every stratum are train, the rest test.

    A row with a null stratum belongs to none and goes to test.
    """
    ranked = hash_rank(df, id_col, seed, [*keys, *strata], "_rank", "_total")
    known = F.lit(True)
    for c in strata:
        known = known & F.col(c).isNotNull()
    return _mark(ranked, F.when(known, F.round(F.lit(fraction) * F.col("_total"))).otherwise(0), out)


def split_validation(
    df: DataFrame, id_col: str, fraction: float, seed, keys: Sequence[str] = (), subject_col: str | None = None,
    split_col: str = "split",
) -> DataFrame:
    """Cut a validation part out of train, by row or (if given) by subject."""
    train = df.filter(F.col(split_col) == "train").drop(split_col)
    if subject_col:
        cut = split_subjects(train, subject_col, fraction, seed, keys, split_col)
    else:
        cut = split_rows(train, id_col, fraction, seed, keys, split_col)
    cut = cut.withColumn(split_col, F.when(F.col(split_col) == "test", "val").otherwise(F.col(split_col)))
    return cut.unionByName(df.filter(F.col(split_col) != "train"))


def split_predefined(
    df: DataFrame, cohort: DataFrame | None, attrs: Sequence[str], label_col: str = "cohort",
    names: dict[str, str] | None = None, out: str = "split",
) -> DataFrame:
    """Splits named by a cohort table; rows outside every cohort are left out.

    Repeated cohort rows count once. A key under two labels is an error.
    """
    if cohort is None:
        raise ValueError("predefined splits need a cohort table")
    names = names or {"training": "train", "validation": "val", "test": "test"}
    label = F.col(label_col)
    mapped = F.coalesce(*[F.when(label == k, v) for k, v in names.items()])
    table = cohort.select(*attrs, mapped.alias(out)).filter(F.col(out).isNotNull()).groupBy(*attrs)
    table = table.agg(F.min(out).alias(out), F.max(out).alias("_other"))
    clash = F.raise_error(F.concat(F.lit("cohort key with two labels: "), F.to_json(F.struct(*attrs))))
    table = table.withColumn(out, F.when(F.col("_other") == F.col(out), F.col(out)).otherwise(clash)).drop("_other")
    return df.join(table, list(attrs))


def repeat_runs(df: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """Every row once per run, with the run's seed; runs are numbered from 1."""
    runs = F.array(*[F.struct(F.lit(i + 1).alias("run"), F.lit(s).alias("seed")) for i, s in enumerate(seeds)])
    return df.withColumn("_run", F.explode(runs)).select(*df.columns, "_run.run", "_run.seed")


def kfold(df: DataFrame, id_col: str, folds: int = 5, out: str = "fold") -> DataFrame:
    """Contiguous folds in id order; the first n % folds have one row more."""
    run = running_totals(df.select(id_col, F.lit(1).cast("bigint").alias("_one")), [], id_col, ["_one"])
    pos, n = F.col("_one_upto") - 1, F.col("_one_all")
    size, extra = F.floor(n / folds), n % folds
    head = extra * (size + 1)
    fold = F.when(pos < head, F.floor(pos / (size + 1))).otherwise(extra + F.floor((pos - head) / F.greatest(size, F.lit(1))))
    return df.join(run.select(id_col, fold.cast("int").alias(out)), id_col)


def hash_folds(df: DataFrame, id_col: str, folds: int = 5, seed=0, out: str = "fold") -> DataFrame:
    """Folds by id hash: no shuffle at all, sizes equal up to chance."""
    return df.withColumn(out, F.pmod(hash_int(seeded_text(seed, id_col)), F.lit(folds)).cast("int"))


def shuffle_targets(
    df: DataFrame, id_col: str, targets: Sequence[str], seed, keys: Sequence[str] = ()
) -> DataFrame:
    """Targets permuted over rows, events and times staying together."""
    keys = list(keys)
    here = hash_rank(df.drop(*targets), id_col, F.concat(F.lit(f"{seed}"), F.lit(":to")), keys, "_rank")
    there = hash_rank(
        df.select(*keys, id_col, *targets), id_col, F.concat(F.lit(f"{seed}"), F.lit(":from")), keys, "_rank"
    ).drop(id_col)
    return join_null_safe(here, there, [*keys, "_rank"]).drop("_rank")


def binarize_time(df: DataFrame, event: str, time: str, threshold: float = 365.0, out: str = "label") -> DataFrame:
    """1 for an event before the threshold, 0 after it, NULL if censored before."""
    label = F.when(F.col(time) > threshold, 0).when(F.col(event) == 1, 1)
    return df.withColumn(out, label)


def high_low_groups(
    df: DataFrame, risk: str, keys: Sequence[str] = (), threshold: float | None = None, out: str = "risk_group"
) -> DataFrame:
    """Predicted-low and predicted-high rows; the default cut is the median risk."""
    if threshold is not None:
        return df.withColumn(out, F.when(F.col(risk) <= threshold, "low").otherwise("high"))
    med = exact_quantiles(df, keys, risk, [0.5], out="_cut")
    cut = F.col("_cut")[0]
    joined = join_null_safe(df, med, keys) if keys else df.withColumn("_cut", med.scalar())
    return joined.withColumn(out, F.when(F.col(risk) <= cut, "low").otherwise("high")).drop("_cut")
