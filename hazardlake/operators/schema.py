"""Feature columns, their modality (name suffix) and wide/long reshaping.

Everything here works on column names; it reads no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def features_by_modality(
    columns: Sequence[str],
    suffixes: Mapping[str, str],
    allow: Mapping[str, Sequence[str]] | None = None,
) -> dict[str, list[str]]:
    """Columns of each modality; a non-empty allow-list narrows its modality."""
    found: dict[str, list[str]] = {}
    for modality, suffix in suffixes.items():
        wanted = set((allow or {}).get(modality) or columns)
        found[modality] = [c for c in columns if c.endswith(suffix) and c in wanted]
    return found


def feature_dictionary(df: DataFrame, by_modality: Mapping[str, Sequence[str]]) -> DataFrame:
    """``(feature, modality, pos)``; one row per feature column of ``df``."""
    order = {c: i for i, c in enumerate(df.columns)}
    rows = [(f, m, order[f]) for m, fs in by_modality.items() for f in fs]
    return df.sparkSession.createDataFrame(rows, "feature string, modality string, pos int")


def keep_modalities(
    df: DataFrame, by_modality: Mapping[str, Sequence[str]], subset: Sequence[str], keep: Sequence[str]
) -> DataFrame:
    """Ids and targets plus the features of the modalities in ``subset``."""
    return df.select(*keep, *[f for m, fs in by_modality.items() if m in subset for f in fs])


def keep_features(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, *[f for f in features if f not in keep])


def forced_column(
    df: DataFrame, source: DataFrame, id_col: str, column: str, include: bool, subset: Sequence[str],
    clinical: str = "CLINICAL",
) -> DataFrame:
    """Add ``column`` back when asked for without its modality, or drop it.

    ``source`` is the table before feature projection, joined by row id.
    """
    if include and clinical not in subset and column not in df.columns:
        return add_by_row(df, source.select(id_col, column), id_col)
    if not include and clinical in subset and column in df.columns:
        return df.drop(column)
    return df


def add_by_row(df: DataFrame, extra: DataFrame, id_col: str) -> DataFrame:
    """Columns of ``extra`` attached by row id."""
    return df.join(extra, id_col, "left")


def modality_slice(
    df: DataFrame, by_modality: Mapping[str, Sequence[str]], modality: str, keep: Sequence[str]
) -> DataFrame:
    """One modality with ids, targets and type; the split column rides along."""
    return df.select(*keep, *by_modality[modality])


def drop_unnamed(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("Unnamed")])


def melt(df: DataFrame, features: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Long form ``(ids, feature, value)`` of numeric features; NaN becomes NULL."""
    cast = df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features])
    long = cast.unpivot(list(ids), list(features), "feature", "value")
    return long.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def melt_text(df: DataFrame, features: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Long form of categorical features with their values as text."""
    cast = df.select(*ids, *[F.col(f).cast("string").alias(f) for f in features])
    return cast.unpivot(list(ids), list(features), "feature", "level")


def widen(long: DataFrame, ids: Sequence[str], features: Sequence[str], value: str = "value") -> DataFrame:
    """Back to one row per id, one column per feature."""
    return long.groupBy(*ids).agg(
        *[F.max(F.when(F.col("feature") == f, F.col(value))).alias(f) for f in features]
    )


def as_vector(df: DataFrame, features: Sequence[str], keep: Sequence[str], out: str = "x") -> DataFrame:
    """Features packed into one array column, in the given order."""
    return df.select(*keep, F.array(*[F.col(f).cast("double") for f in features]).alias(out))
