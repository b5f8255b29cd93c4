"""Projections, filters and set operations that keep one row per input row."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propspark.functions.scalars import blank_to_null, says_false
from propspark.sources.tables import is_empty, require_columns


def complete_rows(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Project and drop rows with any missing projected value."""
    cols = list(cols)
    require_columns(df, *cols)
    return df.select(*cols).dropna("any")


def present_and_renamed(df: DataFrame, col: str, new_name: str) -> DataFrame:
    require_columns(df, col)
    return df.dropna(subset=[col]).withColumnRenamed(col, new_name)


def exclude_values(df: DataFrame, key: str, values: Iterable, *, value_col: str | None = None) -> DataFrame:
    """Drop listed keys (a missing key is not in any list and stays); optionally need ``value_col``."""
    keep = F.coalesce(~F.col(key).isin(*values), F.lit(True))
    if value_col is not None:
        keep = keep & F.col(value_col).isNotNull()
    return df.filter(keep)


def allow_values(df: DataFrame, key: str, values: Iterable) -> DataFrame:
    return df.filter(F.col(key).isin(*values))


def without_flag(df: DataFrame, flag_col: str) -> DataFrame:
    """Rows that carry no quality remark."""
    return df.filter(F.col(flag_col).isNull())


def exact_values(df: DataFrame, relation_col: str) -> DataFrame:
    """Relation missing or "=": the value is a measurement, not a bound."""
    return df.filter(F.col(relation_col).isNull() | (F.col(relation_col) == "="))


def with_value_and_id(df: DataFrame, value_col: str, id_col: str) -> DataFrame:
    value = blank_to_null(F.col(value_col).cast("string"))
    key = blank_to_null(F.col(id_col).cast("string"))
    return df.filter(value.isNotNull() & key.isNotNull())


def unscaled_rows(df: DataFrame, flag_col: str = "scaling_was_applied") -> DataFrame:
    """Rows whose flag reads "false", whether text or boolean."""
    return df.filter(says_false(flag_col))


def membership_split(df: DataFrame, col: str, values: Iterable, *, flag: str = "is_finetune") -> DataFrame:
    """Flag the selected side; an empty selection is an error, an empty remainder is not."""
    require_columns(df, col)
    out = df.withColumn(flag, F.coalesce(F.col(col).isin(*values), F.lit(False)))
    if is_empty(out.filter(flag)):
        raise ValueError(f"no rows selected by {col}")
    return out


def drop_missing(df: DataFrame, *, keys: Iterable[str] = (), target: str | None = None) -> DataFrame:
    subset = [*keys, *([target] if target else [])]
    return df.dropna(subset=subset) if subset else df


def with_provenance(df: DataFrame, **constants) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in constants.items()})


def renamed(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def align_columns(df: DataFrame, expected: Iterable[str], *, keep: Iterable[str] = ()) -> DataFrame:
    """Expected columns in order; absent ones become null doubles, all others but ``keep`` go."""
    present = set(df.columns)
    cols: list[Column] = [F.col(c) for c in keep]
    cols += [F.col(c) if c in present else F.lit(None).cast("double").alias(c) for c in expected]
    return df.select(*cols)


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """Union by name; columns a source lacks are null."""
    frames = list(frames)
    if not frames:
        raise ValueError("nothing to union")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def ids_missing_from(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    return left.select(key).subtract(right.select(key))
