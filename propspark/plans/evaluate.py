"""Judging predictions against a test set: bootstrap tables, model comparison, error inside the domain."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propspark.functions.scalars import clip_log10, to_bool_lenient, to_number
from propspark.operators.lookups import attach_flag, pair_predictions, require_complete, require_unique
from propspark.operators.metrics import metric_table
from propspark.operators.resample import REPORT_METRICS, bootstrap_metrics
from propspark.operators.rows import union_all
from propspark.operators.summaries import pivot_metrics, rank_rows, with_macro_average
from propspark.sources.tables import is_empty, require_columns

NORMAL, LOG1P = "y_pred_normal", "y_pred_log1p"


def natural_predictions(pred: DataFrame, key: str, endpoint: str, *, name: str = "predictions") -> DataFrame:
    """Key and prediction on the natural scale; which column is used depends on which is present."""
    require_columns(pred, key)
    if NORMAL in pred.columns:
        value = F.col(NORMAL)
    elif LOG1P in pred.columns:
        value = F.expm1(to_number(LOG1P))
    else:
        raise ValueError(f"{name} must contain either '{NORMAL}' or '{LOG1P}'")
    return pred.select(key, value.alias(endpoint))


def scored_pairs(pred: DataFrame, true: DataFrame, key: str, endpoints: Iterable[str], *, check: bool = True) -> DataFrame:
    """Long table ``Endpoint, <key>, y_true, y_pred`` in log10(x + 1), missing values left out."""
    endpoints = list(endpoints)
    if check:
        require_complete(pred, true, key)
        require_unique(pred, key, "predictions")
    parts = []
    for e in endpoints:
        pairs = pair_predictions(pred.select(key, e), true.select(key, e), key, e)
        parts.append(pairs.select(
            F.lit(e).alias("Endpoint"), key,
            clip_log10(to_number(f"{e}_true")).alias("y_true"), clip_log10(to_number(f"{e}_pred")).alias("y_pred"),
        ).dropna(subset=["y_true", "y_pred"]))
    out = union_all(parts)
    if check:
        found = {r["Endpoint"] for r in out.select("Endpoint").distinct().collect()}
        if lacking := [e for e in endpoints if e not in found]:
            raise ValueError(f"no valid data for endpoints {lacking}")
    return out


def evaluation_table(pairs: DataFrame, key: str, *, samples: int = 1000, seed: int = 0, within: Iterable[str] = (), method: str = "exact") -> DataFrame:
    """Bootstrap mean and SD of the report metrics per endpoint, with a macro-average row."""
    within = list(within)
    by = [*within, "Endpoint"]
    long = bootstrap_metrics(pairs, "y_true", "y_pred", by=by, key=key, samples=samples, seed=seed, method=method)
    return with_macro_average(pivot_metrics(long, REPORT_METRICS, by), "Endpoint", within)


def evaluate(pred: DataFrame, true: DataFrame, key: str, endpoints: Iterable[str], *, samples: int = 1000, seed: int = 0) -> DataFrame:
    return evaluation_table(scored_pairs(pred, true, key, endpoints), key, samples=samples, seed=seed)


def compare_models(
    predictions: Mapping[str, DataFrame], true: DataFrame, key: str, true_col: str, *,
    endpoint: str = "HLM", samples: int = 1000, seed: int = 0, use_macro_average: bool = False,
) -> DataFrame:
    """All models in one plan (the model name is a column), ranked by mean MAE."""
    if not predictions:
        raise ValueError("no predictions to compare")
    truth = true.select(key, F.col(true_col).alias(endpoint))
    parts = []
    for name, pred in predictions.items():
        pairs = scored_pairs(natural_predictions(pred, key, endpoint, name=name), truth, key, [endpoint])
        parts.append(pairs.withColumn("Name", F.lit(name)))
    table = evaluation_table(union_all(parts), key, samples=samples, seed=seed, within=["Name"])
    table = table.filter(F.col("Endpoint") == ("Macro Average" if use_macro_average else endpoint))
    return ranked_models(table)


def ranked_models(table: DataFrame) -> DataFrame:
    ranked = rank_rows(table, "mean_MAE", "Name")
    first = ["Rank", "Name", "Endpoint"]
    return ranked.select(*first, *[F.col(f"`{c}`") for c in ranked.columns if c not in first])


def scatter_table(pred: DataFrame, true_col: str, *, flag_col: str | None = None) -> DataFrame:
    """Measured and predicted values in log10(x + 1), finite rows only, with the domain flag and the ends
    of the diagonal."""
    require_columns(pred, true_col, LOG1P)
    has_flag = flag_col is not None and flag_col in pred.columns
    rows = pred.dropna(subset=[true_col, LOG1P, *([flag_col] if has_flag else [])])
    outside = to_bool_lenient(flag_col) if has_flag else F.lit(None).cast("boolean")
    rows = rows.withColumns({
        "measured": clip_log10(to_number(true_col)),
        "predicted": clip_log10(F.expm1(to_number(LOG1P))),
        "outside_ad": outside,
    })
    limit = F.lit(float("inf"))
    rows = rows.filter(F.col("measured").isNotNull() & F.col("predicted").isNotNull() & (F.col("measured") < limit) & (F.col("predicted") < limit))
    low = rows.agg(F.min(F.least("measured", "predicted"))).scalar()
    high = rows.agg(F.max(F.greatest("measured", "predicted"))).scalar()
    return rows.withColumns({"line_min": low, "line_max": high})


def errors_by_domain(pred: DataFrame, flags: DataFrame, key: str, flag_col: str, y: str, p: str, *, metrics=("rmse", "mae")) -> DataFrame:
    """Error metrics of predictions inside and outside the applicability domain."""
    if is_empty(flags):
        raise ValueError("no domain flags")
    rows = attach_flag(pred, flags, key, flag_col)
    return metric_table(rows, y, p, metrics=metrics, by=[flag_col])
