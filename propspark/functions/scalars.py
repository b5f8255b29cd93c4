"""Scalar column functions: unit handling, transforms, coercion, flags."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words accepted as booleans.
TRUE_WORDS = ("1", "true", "yes", "y", "on")
FALSE_WORDS = ("0", "false", "no", "n", "off")
OUTSIDE_WORDS = ("true", "1", "yes")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def from_log10(c: Column | str) -> Column:
    return F.pow(F.lit(10.0), _col(c))


def clip_log10(c: Column | str) -> Column:
    """log10(max(y, 0) + 1); null stays null although ``greatest`` would skip it."""
    c = _col(c)
    return F.when(c.isNotNull(), F.log10(F.greatest(c, F.lit(0.0)) + 1.0))


def scale_where(value: Column | str, unit: Column | str, unit_code: str, factor: float) -> Column:
    """``value * factor`` for rows of one unit; the factor has no default on purpose."""
    value = _col(value)
    return F.when(_col(unit) == unit_code, value * F.lit(float(factor))).otherwise(value)


def mapped(c: Column | str, mapping: Mapping, otherwise=None) -> Column:
    """Literal dictionary lookup; values outside the dictionary become ``otherwise``."""
    c = _col(c)
    out: Column | None = None
    for key, val in mapping.items():
        out = F.when(c == F.lit(key), F.lit(val)) if out is None else out.when(c == F.lit(key), F.lit(val))
    if out is None:
        return F.lit(otherwise)
    return out if otherwise is None else out.otherwise(F.lit(otherwise))


def to_number(c: Column | str) -> Column:
    """Numeric coercion: text that is no finite number becomes null."""
    num = _col(c).try_cast("double")
    return F.when(~F.isnan(num), num)


def _words(c: Column | str) -> Column:
    return F.lower(F.trim(_col(c).cast("string")))


def to_bool(c: Column | str, default: bool | None = None) -> Column:
    """Loose boolean parsing. Null gives ``default``; any other word stops the job."""
    w = _words(c)
    bad = F.raise_error(F.concat(F.lit("not a boolean: "), w)).cast("boolean")
    return (
        F.when(w.isNull(), F.lit(default).cast("boolean"))
        .when(w.isin(*TRUE_WORDS), F.lit(True))
        .when(w.isin(*FALSE_WORDS), F.lit(False))
        .otherwise(bad)
    )


def to_bool_lenient(c: Column | str) -> Column:
    """True for the listed words, false for everything else (null included)."""
    return F.coalesce(_words(c).isin(*OUTSIDE_WORDS), F.lit(False))


def says_false(c: Column | str) -> Column:
    """True where the text form of a mixed boolean column reads "false"."""
    return F.coalesce(_words(c) == "false", F.lit(False))


def prefer_literal(value):
    """A preference value given as text may mean a boolean or nothing."""
    if isinstance(value, str):
        return {"true": True, "false": False, "none": None}.get(value.strip().lower(), value)
    return value


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(_col(c)), F.lit(""))


def structure_status(returned: Column | str, text: Column | str) -> Column:
    """The three outcomes of a structure lookup."""
    return (
        F.when(~F.coalesce(_col(returned), F.lit(False)), F.lit("molecule_not_returned"))
        .when(blank_to_null(text).isNull(), F.lit("blank_smiles"))
        .otherwise(F.lit("smiles_found"))
    )


def to_time(c: Column | str) -> Column:
    return F.to_timestamp(_col(c))


def abs_error(y: Column | str, p: Column | str) -> Column:
    return F.abs(_col(y) - _col(p))


def squared_error(y: Column | str, p: Column | str) -> Column:
    d = _col(y) - _col(p)
    return d * d


def inside_flag(similarity: Column | str, cutoff: Column) -> Column:
    return _col(similarity) >= cutoff
