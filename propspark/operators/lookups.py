"""Joins against lookup tables and between predictions and truth."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propspark.session import broadcast_if_small
from propspark.sources.tables import is_empty, require_columns


def last_written(df: DataFrame, key: str, order: Iterable[str]) -> DataFrame:
    """One row per key: the one written last. Runs as a partial aggregate, so hot keys shrink map-side."""
    order = list(order)
    if not order:
        raise ValueError("an order column is needed to say which row is last")
    rest = [c for c in df.columns if c != key]
    picked = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(key).agg(picked.alias("_row")).select(key, "_row.*")


def lookup(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, cols: dict[str, str], *, hit: str | None = None, how: str = "left") -> DataFrame:
    """Join that brings ``cols`` (dim column to new name); the dim must hold one row per key.

    The dim is broadcast only when its row count is shown to be small. ``hit`` adds a found flag;
    ``how="inner"`` keeps matching rows only, a semi join and a lookup in one.
    """
    take = [F.col(dim_key).alias("_k"), *[F.col(c).alias(n) for c, n in cols.items()]]
    if hit:
        take.append(F.lit(True).alias(hit))
    side = broadcast_if_small(dim.select(*take))
    out = fact.join(side, fact[fact_key] == side["_k"], how).drop("_k")
    return out.withColumn(hit, F.coalesce(F.col(hit), F.lit(False))) if hit else out


def having_match(fact: DataFrame, other: DataFrame, fact_key: str, other_key: str, condition: Column | None = None) -> DataFrame:
    """Semi join with an optional filter on the fact side."""
    if condition is not None:
        fact = fact.filter(condition)
    side = broadcast_if_small(other.select(F.col(other_key).alias("_k")).distinct())
    return fact.join(side, fact[fact_key] == side["_k"], "left_semi")


def without_match(fact: DataFrame, other: DataFrame, fact_key: str, other_key: str) -> DataFrame:
    side = broadcast_if_small(other.select(F.col(other_key).alias("_k")).distinct())
    return fact.join(side, fact[fact_key] == side["_k"], "left_anti")


def pair_predictions(pred: DataFrame, true: DataFrame, key: str, endpoint: str) -> DataFrame:
    """Inner join on the key with ``{endpoint}_pred`` and ``{endpoint}_true`` side by side."""
    require_columns(pred, key, endpoint, label="prediction columns")
    require_columns(true, key, endpoint, label="truth columns")
    return pred.withColumnRenamed(endpoint, f"{endpoint}_pred").join(
        true.select(key, F.col(endpoint).alias(f"{endpoint}_true")), key, "inner"
    )


def missing_keys(pred: DataFrame, true: DataFrame, key: str) -> DataFrame:
    return true.select(key).join(pred.select(key), key, "left_anti").distinct()


def require_complete(pred: DataFrame, true: DataFrame, key: str) -> None:
    if not is_empty(missing_keys(pred, true, key)):
        raise ValueError("predictions lack some rows of the test set")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).count().filter("count > 1")


def require_unique(df: DataFrame, key: str, label: str = "table") -> None:
    if not is_empty(duplicate_keys(df, key)):
        raise ValueError(f"{label} holds duplicated keys in {key}")


def attach_flag(pred: DataFrame, flags: DataFrame, key: str, flag_col: str) -> DataFrame:
    require_columns(flags, key, flag_col)
    return pred.join(flags.select(key, flag_col), key, "left")
