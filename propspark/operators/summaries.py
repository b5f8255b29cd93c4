"""Reports: counts with zero classes, column summaries, histograms, pivots, rankings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propspark.operators.ordered import quantiles
from propspark.sources.tables import require_columns

# Metrics for which a larger value is better.
HIGHER_BETTER = frozenset({"r2", "kendall_tau", "spearman_rho"})


def counts_with_zeros(df: DataFrame, col: str, expected: Iterable, *, name: str = "n") -> DataFrame:
    """Counts in the expected categories, zero where there are no rows."""
    counted = df.groupBy(F.col(col).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    listed = df.sparkSession.createDataFrame([(v,) for v in expected], f"`{col}` {df.schema[col].dataType.simpleString()}")
    return F.broadcast(listed).join(counted, F.col(col) == F.col("_c"), "left").select(
        col, F.coalesce("_n", F.lit(0)).cast("bigint").alias(name)
    )


def counts_by_reason(df: DataFrame, reason_col: str = "preprocess_reason") -> DataFrame:
    return df.groupBy(reason_col).agg(F.count(F.lit(1)).alias("n"))


def sorted_distinct(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct().orderBy(*cols)


def column_summary(df: DataFrame, col: str, by: Iterable[str] = ()) -> DataFrame:
    """Mean, SD, median, MAD, min and max. The MAD is a second pass around the median."""
    by = list(by)
    keyed = df.select(*by, col).filter(F.col(col).isNotNull())
    med = quantiles(keyed, col, {"median": 0.5}, by)
    base = keyed.groupBy(*by) if by else keyed.groupBy(F.lit(0).alias("_g"))
    stats = base.agg(
        F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd"),
        F.min(col).alias("min"), F.max(col).alias("max"),
    )
    if by:
        around = keyed.join(med, by).withColumn("_dev", F.abs(F.col(col) - F.col("median")))
        mad = quantiles(around, "_dev", {"mad": 0.5}, by)
        return stats.join(med, by).join(mad, by)
    m = med.first()["median"]
    dev = keyed.withColumn("_dev", F.abs(F.col(col) - F.lit(m)))
    d = quantiles(dev, "_dev", {"mad": 0.5}).first()["mad"]
    return stats.drop("_g").withColumn("median", F.lit(m)).withColumn("mad", F.lit(d))


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width bins from minimum to maximum, last bin closed, empty bins listed with zero."""
    v = F.col(col)
    lo, hi = df.agg(F.min(col)).scalar(), df.agg(F.max(col)).scalar()
    width = (hi - lo) / bins
    slot = F.when(hi == lo, F.lit(0)).otherwise(F.least(F.floor((v - lo) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)))
    counted = df.filter(v.isNotNull()).groupBy(slot.cast("int").alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(F.broadcast(counted), F.col("bin") == F.col("_bin"), "left").select(
        "bin", (lo + F.col("bin") * width).alias("left_edge"), F.coalesce("_n", F.lit(0)).alias("n")
    )


def fold_summary(folds: DataFrame, metrics: Iterable[str], by: Iterable[str] = ("model", "feature_set")) -> DataFrame:
    """Mean and sample SD of every fold metric; the SD of a single fold is 0."""
    aggs: list[Column] = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std")]
    return folds.groupBy(*by).agg(*aggs)


def pivot_metrics(long: DataFrame, metrics: Iterable[str], by: Iterable[str] = ("Endpoint",)) -> DataFrame:
    """Long (Metric, Value) rows to ``mean_<metric>`` and ``std_<metric>`` columns; NaN is skipped."""
    metrics = list(metrics)
    value = F.when(~F.isnan("Value"), F.col("Value"))
    wide = long.groupBy(*by).pivot("Metric", metrics).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return wide.select(
        *by,
        *[F.col(f"`{m}_mean`").alias(f"mean_{m}") for m in metrics],
        *[F.col(f"`{m}_std`").alias(f"std_{m}") for m in metrics],
    )


def with_macro_average(table: DataFrame, by: str = "Endpoint", within: Iterable[str] = ()) -> DataFrame:
    """Append the mean over endpoints as a row named "Macro Average"."""
    within = list(within)
    nums = [c for c in table.columns if c != by and c not in within]
    avg = table.groupBy(*within).agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in nums]).withColumn(by, F.lit("Macro Average"))
    return table.unionByName(avg)


def rank_rows(table: DataFrame, score: str, tie: str, *, ascending: bool = True, name: str = "Rank") -> DataFrame:
    """1..n in score order. Meant for result tables with one row per model, which are small."""
    key = F.col(score).asc() if ascending else F.col(score).desc()
    return table.withColumn(name, F.row_number().over(Window.orderBy(key, F.col(tie).asc())))


def best_combination(summary: DataFrame, primary_metric: str) -> DataFrame:
    """The winning (model, feature set) row; the direction follows from the metric."""
    col = f"{primary_metric}_mean"
    require_columns(summary, col)
    key = F.col(col).desc() if primary_metric in HIGHER_BETTER else F.col(col).asc()
    return summary.orderBy(key, "model", "feature_set").limit(1)
