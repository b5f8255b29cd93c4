"""Key standardisation with reason codes. Rows are never dropped."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propspark.functions.text import collapse_blanks, let
from propspark.sources.tables import require_columns

# Reason codes of rows without a standard key.
EMPTY = "empty_smiles"
INVALID = "invalid_smiles"
EMPTY_AFTER_STRIP = "empty_after_desalt"
ERROR_PREFIX = "standardize_error:"


def strip_fragments(c: Column, separator: str, strip: Iterable[str]) -> Column:
    """Drop listed fragments, but keep the text as it is when all of them are listed."""
    listed = F.array(*[F.lit(s) for s in strip]) if (strip := list(strip)) else F.array().cast("array<string>")

    def body(parts: Column) -> Column:
        kept = F.filter(parts, lambda f: ~F.array_contains(listed, f))
        return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(parts), separator)

    return let(F.split(c, "\\Q" + separator + "\\E"), body)


def standardize_key(
    df: DataFrame,
    col: str,
    *,
    valid_regex: str = r".",
    separator: str | None = None,
    strip: Iterable[str] = (),
    lower: bool = False,
    collapse: bool = False,
    out_col: str | None = None,
    reason_col: str = "preprocess_reason",
) -> DataFrame:
    """Add a standard key and a reason; exactly one of the two is null in every row.

    The checks run in order: missing or blank, not matching ``valid_regex``, nothing left after
    fragments were stripped.
    """
    require_columns(df, col)
    out_col = out_col or f"{col}_standardized"
    raw = F.col(col).cast("string")
    if isinstance(df.schema[col].dataType, (T.DoubleType, T.FloatType)):
        raw = F.when(~F.isnan(col), raw)
    text = F.trim(F.regexp_replace(raw, r"^\s+|\s+$", ""))
    staged = df.withColumn("_raw", text)
    key = F.col("_raw")
    if separator is not None:
        key = strip_fragments(key, separator, strip)
    if lower:
        key = F.lower(key)
    key = collapse_blanks(key) if collapse else F.trim(key)
    staged = staged.withColumn("_key", key)
    reason = (
        F.when(F.col("_raw").isNull() | (F.col("_raw") == ""), F.lit(EMPTY))
        .when(~F.col("_raw").rlike(valid_regex), F.lit(INVALID))
        .when(F.col("_key") == "", F.lit(EMPTY_AFTER_STRIP))
    )
    return (
        staged.withColumn(reason_col, reason)
        .withColumn(out_col, F.when(F.col(reason_col).isNull(), F.col("_key")))
        .drop("_raw", "_key")
        .select(*df.columns, out_col, reason_col)
    )


def standardize_with(
    df: DataFrame,
    col: str,
    fn: Callable[[str], tuple[str | None, str | None]],
    *,
    out_col: str | None = None,
    reason_col: str = "preprocess_reason",
) -> DataFrame:
    """Run a user's own standardiser (text in, value and reason out) over Arrow batches.

    Blank keys never reach it, and an exception becomes a reason code instead of a failed job.
    """
    require_columns(df, col)
    out_col = out_col or f"{col}_standardized"
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType()), T.StructField(reason_col, T.StringType())])

    def one(value) -> tuple[str | None, str | None]:
        if value is None or value != value or not str(value).strip():
            return None, EMPTY
        try:
            return fn(str(value).strip())
        except Exception as e:  # noqa: BLE001 - the reason code carries the type
            return None, f"{ERROR_PREFIX}{type(e).__name__}"

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            pairs = [one(v) for v in pdf[col]]
            yield pdf.assign(**{out_col: [p[0] for p in pairs], reason_col: [p[1] for p in pairs]})

    return df.mapInPandas(batches, schema)
