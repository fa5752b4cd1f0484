"""The whole flow: cohort, split, preprocess, select, model, combine, summarise."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlake.operators import cohort, ensemble, modelling, preprocess, schema, stability, unsupervised
from hazardlake.session import materialize
from hazardlake.sources import sinks, tables

FUSIONS = ("early", "intermediate", "late")


@dataclass
class Options:
    """What one experiment does; names follow the tables' own columns."""

    suffixes: Mapping[str, str]
    subsets: Sequence[Sequence[str]]
    types: Sequence[Sequence[str]] = (("ALL",),)
    models: Sequence[str] = ("CPH-L2",)
    num_runs: int = 5
    master_seed: int | str = 0
    seeds: Sequence[int] | None = None
    fraction: float = 0.8
    split_mode: str = "subject"  # row, subject, stratified, predefined
    strata: Sequence[str] = ()
    cohorts: DataFrame | None = None
    cohort_attrs: Sequence[str] = ("subject_id",)
    subject_col: str = "subject_id"
    type_col: str = "type"
    categorical: Sequence[str] = ()
    allow: Mapping[str, Sequence[str]] | None = None
    missing: Mapping[str, str | None] = field(default_factory=dict)
    scalers: Mapping[str, str] = field(default_factory=dict)
    selection: str = "statistical"  # or none
    variance_threshold: float | None = 0.05
    handle_correlated: str = "drop"
    corr_threshold: float = 0.8
    target_mode: str = "discrete"
    method: str = "JMI"
    k: int = 50
    n_bins: int = 10
    n_bootstraps: int = 5
    stability_threshold: int = 2
    fusion: str = "early"
    forced_column: str | None = None
    include_forced: bool = False
    grids: Mapping[str, Mapping[str, Sequence]] | None = None
    model_options: Mapping[str, Mapping[str, Any]] | None = None
    folds: int = 5
    importances: bool = False
    fusion_threshold: float = 0.53


KEEP = ["row_id", "split", "type", "os", "os_time"]


def assign_split(df: DataFrame, o: Options, seed) -> DataFrame:
    """train / val / test; validation is cut from train unless predefined."""
    if o.split_mode == "predefined":
        out = cohort.split_predefined(df, o.cohorts, o.cohort_attrs)
        return out if not out.filter("split = 'val'").isEmpty() else cohort.split_validation(out, "row_id", o.fraction, seed)
    by_subject = o.split_mode == "subject"
    if by_subject:
        out = cohort.split_subjects(df, o.subject_col, o.fraction, seed)
    elif o.split_mode == "row":
        out = cohort.split_rows(df, "row_id", o.fraction, seed)
    elif o.split_mode == "stratified":
        out = cohort.split_stratified(df, "row_id", o.strata, o.fraction, seed)
    else:
        raise ValueError(f"unknown split mode: {o.split_mode}")
    return cohort.split_validation(out, "row_id", o.fraction, seed, subject_col=o.subject_col if by_subject else None)


def project_fitted(df: DataFrame, features: Sequence[str], fills: Mapping[str, float], scales: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Imputation and scaling as one projection; values fitted beforehand, one per column."""
    out = []
    for c in df.columns:
        if c not in features:
            out.append(F.col(c))
            continue
        v = F.col(c).cast("double")
        v = F.when(~F.isnan(v), v)
        if fills.get(c) is not None:
            v = F.coalesce(v, F.lit(float(fills[c])))
        if c in scales:
            v = (v - F.lit(scales[c][0])) / F.lit(scales[c][1])
        out.append(v.alias(c))
    return df.select(*out)


def encode_categorical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Ordinal codes in place of text; codes come from training rows."""
    if not columns:
        return df
    levels = preprocess.fit_levels(schema.melt_text(df.filter("split = 'train'"), columns, ["row_id"]))
    for c in columns:
        codes = levels.filter(F.col("feature") == c).select(F.col("level").alias(c), F.col("code").cast("double").alias("_code"))
        df = df.withColumn(c, F.col(c).cast("string")).join(codes, c, "left").drop(c).withColumnRenamed("_code", c)
    return df


def prepare(df: DataFrame, o: Options, subset: Sequence[str], seed) -> tuple[DataFrame, dict[str, list[str]]]:
    """Split, impute, scale and select; wide rows with ``KEEP`` and the features."""
    by_mod = schema.features_by_modality(df.columns, o.suffixes, o.allow)
    df = cohort.drop_incomplete(df, preprocess.rows_to_drop(by_mod, o.missing))
    names = {m: fs for m, fs in by_mod.items() if m in subset}
    features = [f for fs in names.values() for f in fs]
    if o.type_col != "type":
        df = df.withColumn("type", F.col(o.type_col))
    split = assign_split(df, o, seed)
    extra = [o.forced_column] if o.forced_column and o.forced_column not in features else []
    split = split.select(*KEEP, *[c for c in extra if c in split.columns], *features)
    split = materialize(encode_categorical(split, [c for c in o.categorical if c in features]))
    train = split.filter("split = 'train'")

    long = schema.melt(train, features, ["row_id"])
    fills = {r["feature"]: r["fill"] for r in preprocess.fit_impute(long, names, o.missing).collect()}  # one row per feature
    train = project_fitted(train, features, fills, {})
    scales = {}
    if o.selection != "none":
        fitted = preprocess.fit_scales(schema.melt(train, features, ["row_id"]), names, {m: k for m, k in o.scalers.items() if m in names})
        scales = {r["feature"]: (r["center"], r["scale"]) for r in fitted.collect()}  # one row per feature
    ready = materialize(project_fitted(split, features, fills, scales))
    if o.selection == "none":
        return _forced(ready, ready, o, subset), names

    def screen(rows: DataFrame) -> tuple[list[str], DataFrame | None]:
        return unsupervised.unsupervised_screen(
            schema.as_vector(rows, features, ["row_id"]), schema.melt(rows, features, ["row_id"]), features,
            o.handle_correlated, o.variance_threshold, o.corr_threshold,
        )

    train = ready.filter("split = 'train'")
    kept, inside = features, None
    if o.handle_correlated == "group":
        # group columns must exist in every split, so they are fitted once, on all training rows
        kept, groups = screen(train)
        members: dict[str, list[str]] = {}
        for r in groups.collect() if groups is not None else []:  # at most one row per correlated pair
            members.setdefault(r["group"], []).append(r["member"])
        for g, ms in members.items():
            vals = F.filter(F.array(*[F.col(m) for m in sorted(ms)]), lambda v: v.isNotNull())
            ready = ready.withColumn(g, F.aggregate(vals, F.lit(0.0), lambda a, v: a + v) / F.size(vals))
        train = ready.filter("split = 'train'")
    elif o.n_bootstraps == 0:
        kept, _ = screen(train)
    else:
        inside = lambda rows: screen(rows)[0]
    of = schema.features_by_modality(kept, o.suffixes)
    kept = [f for fs in of.values() for f in fs if f in kept]
    where = {f: i for i, fs in enumerate(of.values()) for f in fs}
    gids = [where[f] for f in kept] if o.fusion != "early" else None
    y = preprocess.discretize_target(train.select("row_id", "os_time"), "os_time", o.target_mode, o.n_bins)
    picks = stability.supervised_screen(train.select("row_id", *kept), kept, y, o.method, o.k, o.n_bins, o.n_bootstraps, gids, seed, screen=inside)
    if o.n_bootstraps > 1:
        chosen = df.sparkSession.createDataFrame([(p["run"], p["feature"]) for p in picks], "run int, feature string")
        first = len([p for p in picks if p["run"] == 0])
        stable = stability.stability_select(chosen, o.stability_threshold, first).orderBy("rank").collect()
        selected = [r["feature"] for r in stable]
    else:
        selected = [p["feature"] for p in sorted(picks, key=lambda p: (p["group"], p["rank"]))]
    out = ready.select(*KEEP, *[c for c in extra if c in ready.columns], *selected)
    return _forced(out, ready, o, subset), schema.features_by_modality(selected, {m: s for m, s in o.suffixes.items() if m in subset})


def _forced(df: DataFrame, source: DataFrame, o: Options, subset: Sequence[str]) -> DataFrame:
    if o.forced_column is None or o.forced_column not in source.columns:
        return df
    return schema.forced_column(df, source, "row_id", o.forced_column, o.include_forced, subset)


def _union(parts: Sequence[DataFrame]) -> DataFrame | None:
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else None


def _fingerprint(o: Options) -> str:
    """What a stored step depends on, beside its types, subset and seed."""
    skip = {"types", "subsets", "seeds", "num_runs", "cohorts", "fusion_threshold"}
    return hashlib.md5(repr(sorted((k, v) for k, v in vars(o).items() if k not in skip)).encode()).hexdigest()[:12]


def _prepared(df: DataFrame, o: Options, subset: Sequence[str], seed) -> dict[str, DataFrame]:
    """`prepare` as tables: wide rows, and the features of every modality in order."""
    wide, by_mod = prepare(df, o, subset, seed)
    rows = [(i, m, k, f) for i, (m, fs) in enumerate(by_mod.items()) for k, f in enumerate(fs)]
    rows += [(i, m, -1, None) for i, m in enumerate(by_mod)]  # a modality may have lost all its features
    return {"wide": wide, "features": df.sparkSession.createDataFrame(rows, "part int, modality string, pos int, feature string")}


def _modelled(part: DataFrame, feats: Sequence[str], o: Options, seed) -> dict[str, DataFrame]:
    """Predictions, C-indices and importances of all models of one modality as tables."""
    pool = modelling.model_pool(part, feats, o.models, o.grids, o.model_options, folds=o.folds, importances=o.importances, seed=seed)
    perf = [(s, t.model, c) for t in pool for s, c in sorted(t.cindex.items())]
    out = {
        "predictions": _union([t.predictions.select("split", "row_id", "model", "type", "os", "os_time", "risk") for t in pool]),
        "performance": part.sparkSession.createDataFrame(perf, "split string, model string, cindex double"),
    }
    imps = [t.importances for t in pool if t.importances is not None]
    return out | ({"importances": _union(imps)} if imps else {})


def run_experiment(df: DataFrame, o: Options, store: str | None = None) -> dict[str, DataFrame]:
    """All groups of types x modality subsets x runs.

    Result tables: ``predictions``, ``selected``, ``performance``, ``ensemble``,
    ``importances`` and, for late fusion, ``fusion`` and ``fusion_summary``.  The
    driver loops over fits; every table stays distributed.

    With a ``store`` (a shared folder) every step (types, subset, run, preparation or models of a modality) is
    written when it ends. A later call with the same options reads the finished steps and does the others,
    among them any that was cut off.
    """
    if o.fusion not in FUSIONS:
        raise ValueError(f"unknown fusion: {o.fusion}")
    spark = df.sparkSession
    kept = sinks.Store(spark, store) if store else None
    seeds = list(o.seeds or [r["seed"] for r in tables.draw_seeds(spark, o.num_runs, o.master_seed).orderBy("run").collect()])
    preds, selected, imps, perf = [], [], [], []
    if len(o.types) * len(o.subsets) > 1:
        df = materialize(df)  # derived once, not for every group
    for types, subset in itertools.product(o.types, o.subsets):
        data = materialize(cohort.filter_types(df, types, o.type_col))
        tag = {"types": "_".join(types), "subset": "_".join(subset)}
        for run, seed in enumerate(seeds, start=1):
            name = "/".join([_fingerprint(o), tag["types"], tag["subset"], str(run), str(seed)])
            step = (lambda key, compute: kept.step(f"{name}/{key}", compute)) if kept else (lambda key, compute: compute())
            ready = step("prepared", lambda: _prepared(data, o, subset, seed))
            by_mod: dict[str, list[str]] = {}
            for r in ready["features"].orderBy("part", "pos").collect():  # one row per feature
                by_mod.setdefault(r["modality"], [])
                by_mod[r["modality"]] += [r["feature"]] if r["feature"] is not None else []
            parts = by_mod if o.fusion == "late" else {"_".join(subset): [f for fs in by_mod.values() for f in fs]}
            selected += [(tag["types"], tag["subset"], run, m, f, k) for m, fs in by_mod.items() for k, f in enumerate(fs, start=1)]
            for modality, feats in parts.items():
                if not feats:
                    continue
                part = schema.modality_slice(ready["wide"], {modality: feats}, modality, KEEP)
                done = step(f"models/{modality}", lambda: _modelled(part, feats, o, seed))
                mark = [F.lit(tag["types"]).alias("types"), F.lit(tag["subset"]).alias("subset"), F.lit(run).alias("run")]
                preds.append(done["predictions"].select(*mark, "split", "row_id", "model", F.lit(modality).alias("modality"), "type", "os", "os_time", "risk"))
                # one row per model and split
                perf += [(tag["types"], tag["subset"], run, r["split"], r["model"], modality, r["cindex"]) for r in done["performance"].collect()]
                if "importances" in done:
                    imps.append(done["importances"].select(*mark, F.lit(modality).alias("modality"), "*"))
    pred = _union(preds)
    out = {
        "predictions": pred,
        "selected": spark.createDataFrame(selected, "types string, subset string, run int, modality string, feature string, rank int"),
        "performance": spark.createDataFrame(perf, "types string, subset string, run int, split string, model string, modality string, cindex double"),
    }
    if imps:
        out["importances"] = _union(imps)
    ens, fus, summ = [], [], []
    for types, subset in itertools.product(o.types, o.subsets):
        t, s = "_".join(types), "_".join(subset)
        part = pred.filter((F.col("types") == t) & (F.col("subset") == s)).drop("types", "subset")
        mark = [F.lit(t).alias("types"), F.lit(s).alias("subset")]
        ens.append(ensemble.weighted_ensemble(part).select(*mark, "*"))
        if o.fusion == "late":
            lf = materialize(ensemble.late_fusion(part, threshold=o.fusion_threshold))
            fus.append(lf.select(*mark, "*"))
            summ.append(ensemble.mean_ci_over_runs(lf).select(*mark, "*"))
    out["ensemble"] = _union(ens)
    if fus:
        out["fusion"], out["fusion_summary"] = _union(fus), _union(summ)
    return out
