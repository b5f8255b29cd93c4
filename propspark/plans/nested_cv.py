"""Nested cross-validation over feature sets and models, refit of the winner, and batch scoring."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propspark.operators.folds import SplitConfig, assign_folds, holdout, train_test
from propspark.operators.metrics import METRICS, metric_table
from propspark.operators.rows import drop_missing, union_all
from propspark.operators.summaries import best_combination, fold_summary
from propspark.plans.features import Feature, featurize
from propspark.plans.models import MODELS, FittedModel, fit_model, load_model, save_model
from propspark.plans.search import SearchConfig, tune
from propspark.session import broadcast_if_small, cut_lineage
from propspark.sources.tables import is_empty, read_table, require_columns, write_artifacts, write_table


@dataclass(frozen=True)
class RunConfig:
    key_column: str
    target_column: str
    id_column: str
    feature_sets: Mapping[str, tuple[Feature, ...]]
    models: tuple[str, ...] = ("rf",)
    metrics: tuple[str, ...] = ("rmse", "mae", "r2")
    primary_metric: str = "rmse"
    split: SplitConfig = SplitConfig()
    search: SearchConfig = SearchConfig()
    dropna_target: bool = True
    dropna_key: bool = True
    refit_best_model: bool = True
    random_state: int = 0
    parallelism: int = 1
    model_params: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)


@dataclass
class CvResult:
    folds: DataFrame
    summary: DataFrame
    predictions: DataFrame
    best_row: dict[str, Any]
    best_params: dict[str, list[dict]]
    refit: FittedModel | None = None
    feature_names: dict[str, list[str]] = field(default_factory=dict)


def _checked(df: DataFrame, cfg: RunConfig) -> DataFrame:
    require_columns(df, cfg.key_column, cfg.target_column, cfg.id_column)
    if cfg.primary_metric not in cfg.metrics:
        raise ValueError("primary_metric must be one of the metrics")
    if bad := set(cfg.metrics) - set(METRICS):
        raise ValueError(f"unknown metric: {sorted(bad)}")
    if bad := set(cfg.models) - set(MODELS):
        raise ValueError(f"unknown model: {sorted(bad)}")
    return drop_missing(df, keys=[cfg.key_column] if cfg.dropna_key else (), target=cfg.target_column if cfg.dropna_target else None)


def _search(train: DataFrame, features, model: str, cfg: RunConfig, n_inner: int) -> dict[str, Any]:
    """Search on the inner folds (column ``_inner``) of training rows only."""
    best, _ = tune(train, features, cfg.target_column, model, cfg.search, split=cfg.split, n_folds=n_inner,
                   fixed=dict(cfg.model_params.get(model, {})), seed=cfg.random_state)
    return best


def fold_matrix(folded: DataFrame, cfg: RunConfig, outer: Sequence[int]) -> DataFrame:
    """Per id ``_inner_of``: for every outer fold that trains on the row, its inner fold there.

    Ids and fold numbers alone are stored; all feature sets, models and trials share the table.
    """
    needed = {cfg.id_column, "_outer", *filter(None, (cfg.split.group_column, cfg.split.time_column))}
    keyed = folded if cfg.split.derived_key else folded.select(*[c for c in folded.columns if c in needed])
    parts = []
    for fold in outer:
        train, _ = train_test(keyed, cfg.split, fold, name="_outer")
        inner = assign_folds(train, cfg.id_column, cfg.split, cfg.split.inner_folds, name="_in")
        parts.append(inner.select(F.col(cfg.id_column).alias("_id"), F.lit(fold).alias("_of"), "_in"))
    each = union_all(parts).groupBy("_id", "_of").agg(F.min("_in").cast("int").alias("_in"))
    return cut_lineage(each.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("_of", "_in"))).alias("_inner_of")))


def run_nested_cv(df: DataFrame, cfg: RunConfig) -> CvResult:
    """Score every (feature set, model) on outer folds, pick the best, refit it on all rows.

    Outer and inner folds are assigned once and kept as columns; features are computed once per feature set
    and stored for all models, folds and trials. Scores of all folds come from the stored predictions in one aggregate.
    """
    rows = _checked(df, cfg)
    folded = cut_lineage(assign_folds(rows, cfg.id_column, cfg.split, cfg.split.outer_folds, name="_outer"))
    counts = {r["_outer"]: r["n"] for r in folded.groupBy("_outer").agg(F.count(F.lit(1)).alias("n")).collect()}
    outer = sorted(k for k in counts if k >= 1)
    n_inner: dict[int, int] = {}
    if cfg.search.enabled:
        matrix = fold_matrix(folded, cfg, outer)
        n_inner = {r["of"]: r["n"] for r in matrix.select(F.explode("_inner_of").alias("of", "n")).groupBy("of").agg(F.max("n").alias("n")).collect()}
        folded = folded.join(broadcast_if_small(matrix), F.col(cfg.id_column).eqNullSafe(F.col("_id"))).drop("_id")
    best_params: dict[str, list[dict]] = {}
    names: dict[str, list[str]] = {}
    tables: list[DataFrame] = []
    for fs, features in cfg.feature_sets.items():
        data = cut_lineage(featurize(folded, features))
        for model in cfg.models:
            def one(fold: int, model=model, features=features, data=data, fs=fs):
                df.sparkSession.sparkContext.setLocalProperty("spark.scheduler.pool", f"{model}-{fs}-fold-{fold}")
                tr, te = train_test(data, cfg.split, fold, name="_outer")
                found = {}
                if cfg.search.enabled:
                    found = _search(tr.withColumn("_inner", F.col("_inner_of")[F.lit(fold)]), features, model, cfg, n_inner[fold])
                fitted = fit_model(tr, features, cfg.target_column, model,
                                   params={**cfg.model_params.get(model, {}), **found}, seed=cfg.random_state)
                scored = fitted.predict(te, "y_pred").select(
                    F.col(cfg.id_column).alias("row_id"), F.lit(model).alias("model"), F.lit(fs).alias("feature_set"),
                    F.lit(fold).alias("outer_fold"), F.col(cfg.target_column).cast("double").alias("y_true"), "y_pred")
                return found, cut_lineage(scored), fitted.feature_names

            with ThreadPoolExecutor(max(1, cfg.parallelism)) as pool:
                got = list(pool.map(one, outer))
            best_params[f"{model}__{fs}"] = [g[0] for g in got]
            names[f"{model}__{fs}"] = got[-1][2]
            tables += [g[1] for g in got]
    predictions = union_all(tables)
    if is_empty(predictions):
        raise RuntimeError("no cross-validation results")
    folds, summary = score_predictions(predictions, cfg.metrics, counts, cfg.split)
    best = best_combination(summary, cfg.primary_metric).first().asDict()
    refit = None
    if cfg.refit_best_model:
        features = cfg.feature_sets[best["feature_set"]]
        data = featurize(rows, features)
        found = {}
        if cfg.search.enabled:
            data = cut_lineage(assign_folds(data, cfg.id_column, cfg.split, cfg.split.inner_folds, name="_inner"))
            found = _search(data, features, best["model"], cfg, int(data.agg(F.max("_inner")).first()[0]))
        refit = fit_model(data, features, cfg.target_column, best["model"],
                          params={**cfg.model_params.get(best["model"], {}), **found}, seed=cfg.random_state)
    return CvResult(folds, summary, predictions, best, best_params, refit, names)


def score_predictions(predictions: DataFrame, metrics: Sequence[str], counts: Mapping[int, int] | None = None, split: SplitConfig = SplitConfig()) -> tuple[DataFrame, DataFrame]:
    """Fold table and summary from stored out-of-fold predictions."""
    folds = metric_table(predictions, "y_true", "y_pred", metrics=metrics, by=["model", "feature_set", "outer_fold"])
    folds = folds.withColumnRenamed("n", "n_test")
    if counts is not None:
        expanding = split.method == "time_series"
        size = {f: sum(n for g, n in counts.items() if (g < f if expanding else g != f)) for f in counts if f >= 1}
        n_train = F.lit(None).cast("bigint")
        for f, n in size.items():
            n_train = F.when(F.col("outer_fold") == f, F.lit(n).cast("bigint")).otherwise(n_train)
        folds = folds.withColumn("n_train", n_train).select("model", "feature_set", "outer_fold", "n_train", "n_test", *metrics)
    folds = cut_lineage(folds)
    return folds, fold_summary(folds, metrics)


def save_cv(result: CvResult, root: str, spark: SparkSession) -> None:
    """Fold results, summary, predictions, parameters and feature names as tables; the refitted model beside them.

    Feature names are those of the last fold, whose training rows are the most in a time split.
    """
    params = spark.createDataFrame(
        [(combo, fold + 1, json.dumps(p)) for combo, per in result.best_params.items() for fold, p in enumerate(per)],
        "combination string, outer_fold int, params string")
    names = spark.createDataFrame([(combo, i, n) for combo, own in result.feature_names.items() for i, n in enumerate(own)],
                                  "combination string, position int, feature string")
    write_artifacts({"feature_names": names, "fold_results": result.folds, "summary": result.summary, "predictions": result.predictions, "best_params": params},
                    root, partition_by={"predictions": ["model", "feature_set"]})
    if result.refit is not None:
        save_model(result.refit, f"{root}/refit", spark, feature_set=result.best_row["feature_set"], extra={"summary_row": result.best_row})


def fit_with_holdout(df: DataFrame, features: Sequence[Feature], cfg: RunConfig, model: str, fraction: float = 0.1) -> tuple[FittedModel, DataFrame]:
    """Fit on the training side of a hold-out and return the scored validation rows."""
    rows = featurize(holdout(_checked(df, cfg), cfg.id_column, cfg.split, fraction), features)
    fitted = fit_model(rows.filter("NOT is_valid"), features, cfg.target_column, model,
                       params=dict(cfg.model_params.get(model, {})), seed=cfg.random_state)
    return fitted, fitted.predict(rows.filter("is_valid"), "y_pred")


def score_table(fitted: FittedModel, df: DataFrame, *, key_column: str, prediction_column: str = "prediction") -> DataFrame:
    """All input columns plus the prediction. Numeric columns the model expects and the table lacks are null."""
    require_columns(df, key_column)
    before = df.columns
    made = {c for f in fitted.features if f.kind == "profile" for c in f.numbers}
    lacking = [c for f in fitted.features for c in f.numbers if c not in made and c not in before]
    work = df.withColumns({c: F.lit(None).cast("double") for c in lacking}) if lacking else df
    scored = fitted.predict(featurize(work, fitted.features), prediction_column, label=key_column)
    return scored.select(*before, prediction_column)


def predict_from_refit(spark: SparkSession, *, input_path: str, refit_dir: str, output_path: str, key_column: str,
                       prediction_column: str = "prediction", fmt: str | None = None) -> DataFrame:
    fitted, _ = load_model(spark, refit_dir)
    out = score_table(fitted, read_table(spark, input_path, fmt=fmt, required=[key_column]), key_column=key_column, prediction_column=prediction_column)
    write_table(out, output_path)
    return out
