"""Replicate collapse: one clean value per key."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propspark.functions.scalars import prefer_literal
from propspark.operators.ordered import GROUP_ROWS_PER_TASK, has_large_groups, quantiles
from propspark.operators.rows import drop_missing
from propspark.sources.tables import require_columns

METHODS = ("mean", "median", "min", "max")


def first_nonnull(col: str, order: Iterable[str], only: Column | None = None) -> Column:
    """First non-missing value of a group in row order (a partial aggregate)."""
    keep = F.col(col).isNotNull() if only is None else F.col(col).isNotNull() & only
    return F.min_by(F.when(keep, F.col(col)), F.when(keep, F.struct(*order)))


def _preferred(df: DataFrame, prefer_col: str, prefer_value: Any) -> Column:
    """Whether a row has the preferred value; a value of another kind than the column never matches.

    Text is not compared with booleans or numbers, so the text "False" is not the boolean false.
    """
    value, kind = prefer_literal(prefer_value), df.schema[prefer_col].dataType
    same = {bool: T.BooleanType, str: T.StringType, int: T.NumericType, float: T.NumericType}.get(type(value))
    if same is not None and not isinstance(kind, same):
        return F.lit(False)
    return F.coalesce(F.col(prefer_col) == F.lit(value), F.lit(False))


def _check_preference(df: DataFrame, prefer_col: str, prefer_value: Any) -> None:
    if prefer_value is None:
        raise ValueError("prefer_value must be provided when prefer_col is set")
    require_columns(df, prefer_col, label="prefer_col")


def prefer_rows(df: DataFrame, *, key_cols: Iterable[str], prefer_col: str, prefer_value: Any) -> DataFrame:
    """Keep only preferred rows in groups that hold both kinds; leave uniform groups alone.

    Only the other rows of mixed groups go: every row looks up whether its key owns a preferred row. The keys are
    one column pass, the rows another; a hot key's rows may be split over tasks. Null keys form a group.
    """
    keys = list(key_cols)
    _check_preference(df, prefer_col, prefer_value)
    flagged = df.withColumn("_p", _preferred(df, prefer_col, prefer_value))
    owners = flagged.filter("_p").select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct().withColumn("_mixed", F.lit(True))
    met = flagged.join(owners, [flagged[k].eqNullSafe(owners[f"_k_{k}"]) for k in keys], "left")
    return met.filter(F.col("_p") | F.col("_mixed").isNull()).select(*[F.col(f"`{c}`") for c in df.columns])


def deduplicate(
    df: DataFrame,
    *,
    key_cols: Iterable[str],
    target_col: str,
    method: str = "mean",
    keep_cols: Iterable[str] = (),
    order_cols: Iterable[str] = (),
    drop_missing_keys: bool = True,
    drop_missing_target: bool = True,
    prefer_col: str | None = None,
    prefer_value: Any | None = None,
    group_rows: int = GROUP_ROWS_PER_TASK,
) -> DataFrame:
    """Collapse replicates to one row per key.

    Output: keys, kept columns (first non-missing in ``order_cols`` order), ``{target}_deduplicated``,
    ``n_reps``, ``y_std`` (sample; null for one row), ``y_min``, ``y_max``. The preference rule is folded
    into the same aggregate: each statistic is computed for preferred rows and for all rows side by side,
    and the group takes the first set where it has any preferred row. One shuffle, map-side combined.
    """
    keys = list(key_cols)
    require_columns(df, *keys, label="key_cols")
    require_columns(df, target_col, label="target_col")
    if method not in METHODS:
        raise ValueError(f"unsupported method: {method}")
    if prefer_col is not None:
        _check_preference(df, prefer_col, prefer_value)
    kept = [c for c in keep_cols if c in df.columns and c not in keys]
    order = list(order_cols)
    if kept and not order:
        raise ValueError("keep_cols need order_cols to say which row comes first")

    work = drop_missing(df, keys=keys if drop_missing_keys else (), target=target_col if drop_missing_target else None)
    # Groups that fit a task take their median in the same aggregate as all else; others are range-sorted.
    sort = method == "median" and has_large_groups(work, keys, group_rows)
    if sort and prefer_col is not None:
        work = prefer_rows(work, key_cols=keys, prefer_col=prefer_col, prefer_value=prefer_value)
    prefer = _preferred(work, prefer_col, prefer_value) if prefer_col is not None and not sort else None

    def stats(only: Column | None, tag: str) -> list[Column]:
        y = F.col(target_col) if only is None else F.when(only, F.col(target_col))
        main = {"mean": F.avg(y), "median": F.percentile(y, F.lit(0.5)), "min": F.min(y), "max": F.max(y)}
        out = [first_nonnull(c, order, only).alias(f"{tag}{c}") for c in kept]
        if not sort:
            out.append(main[method].alias(f"{tag}_main"))
        return [*out, F.count(y).alias(f"{tag}n_reps"), F.stddev_samp(y).alias(f"{tag}y_std"),
                F.min(y).alias(f"{tag}y_min"), F.max(y).alias(f"{tag}y_max")]

    target = f"{target_col}_deduplicated"
    names = [*kept, *([] if sort else ["_main"]), "n_reps", "y_std", "y_min", "y_max"]
    if prefer is None:
        grouped = work.groupBy(*keys).agg(*stats(None, ""))
    else:
        both = work.groupBy(*keys).agg(F.max(prefer).alias("_any"), *stats(prefer, "p_"), *stats(None, "a_"))
        grouped = both.select(*keys, *[F.when(F.col("_any"), F.col(f"p_{n}")).otherwise(F.col(f"a_{n}")).alias(n) for n in names])
    if sort:
        med = quantiles(work, target_col, {"_main": 0.5}, keys, group_rows=group_rows)
        med = med.select(*[F.col(k).alias(f"_m_{k}") for k in keys], "_main")
        grouped = grouped.join(med, [grouped[k].eqNullSafe(med[f"_m_{k}"]) for k in keys], "left")
    return grouped.select(*keys, *kept, F.col("_main").alias(target), "n_reps", "y_std", "y_min", "y_max")
