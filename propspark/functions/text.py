"""Text columns: normalisation, keyword predicates, ordered pattern classifier."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    # The plain form: about half the time for short texts.
    from _md5 import md5
except ImportError:
    from hashlib import md5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body`` (it is not evaluated per element)."""
    return F.transform(F.array(value), body)[0]


def collapse_blanks(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_text(*parts: Column, fixes: Iterable[tuple[str, str]] = (("appearant", "apparent"),)) -> Column:
    """Join fields with " | " (missing ones as empty text), lower, mend known typos, collapse blanks."""
    text = F.lower(F.concat_ws(" | ", *[F.coalesce(p, F.lit("")) for p in parts]))
    for wrong, right in fixes:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return collapse_blanks(text)


def contains_all(c: Column, words: Iterable[str]) -> Column:
    """Case-insensitive test that every word occurs; null text counts as no."""
    low = F.lower(c)
    out = F.lit(True)
    for w in words:
        out = out & low.contains(w.lower())
    return F.coalesce(out, F.lit(False))


def contains_any(c: Column, words: Iterable[str]) -> Column:
    low = F.lower(c)
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w.lower())
    return F.coalesce(out, F.lit(False))


@dataclass(frozen=True)
class Category:
    """A class with the patterns that admit a text and those that veto it."""

    name: str
    patterns: tuple[str, ...]
    vetoes: tuple[str, ...] = ()


# The assay classes, most specific first, with their patterns and vetoes.
CLEARANCE_CATEGORIES = (
    Category(
        "unbound",
        (
            r"\bunbound intrinsic\b",
            r"\bintrinsic unbound\b",
            r"\bclint\s*[,/_ -]?\s*u\b",
            r"\bclu\b",
            r"\bfu[,/_ -]?mic\b",
            r"\bmicrosomal unbound clearance\b",
            r"\bunbound clearance\b",
        ),
    ),
    Category(
        "intrinsic",
        (
            r"\bapparent intrinsic\b",
            r"\bintrinsic apparent\b",
            r"\bapparent clint\b",
            r"\bclint\s*[,/_ -]?\s*app\b",
            r"\bclintapp\b",
            r"\bclint[,/_ -]?app\b",
            r"\bintrinsic clearance\b",
            r"\bclint\b",
            r"\bcl int\b",
            r"\bmicrosomal intrinsic clearance\b",
        ),
        (
            r"\bunbound intrinsic\b",
            r"\bclint\s*[,/_ -]?\s*u\b",
            r"\bclu\b",
            r"\bfu[,/_ -]?mic\b",
            r"\bmicrosomal unbound clearance\b",
            r"\bhepatic clearance\b",
            r"\bhepatic intrinsic clearance\b",
            r"\bscaled intrinsic\b",
            r"\bscaled clint\b",
            r"\bivive\b",
            r"\bml/min/kg\b",
            r"\bl/kg/h\b",
            r"\bper\s*kg\b",
        ),
    ),
    Category(
        "hepatic",
        (
            r"\bhepatic clearance\b",
            r"\bhepatic intrinsic clearance\b",
            r"\bscaled intrinsic\b",
            r"\bscaled clint\b",
            r"\bivive\b",
            r"\bin vivo clearance\b",
            r"\bml/min/kg\b",
            r"\bl/kg/h\b",
            r"\bper\s*kg\b",
        ),
    ),
)
UNKNOWN = "unknown"
EXPECTED_BUCKETS = ("intrinsic", "unbound", "hepatic", "unknown")


def matches_any(text: Column, patterns: Iterable[str]) -> Column:
    return F.coalesce(text.rlike("(?i)(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"), F.lit(False))


def classify(text: Column, categories: Iterable[Category] = CLEARANCE_CATEGORIES, default: str = UNKNOWN) -> Column:
    """First category whose patterns match and whose vetoes do not; a vetoed text tries the next one."""
    out: Column | None = None
    for cat in categories:
        hit = matches_any(text, cat.patterns)
        if cat.vetoes:
            hit = hit & ~matches_any(text, cat.vetoes)
        out = F.when(hit, F.lit(cat.name)) if out is None else out.when(hit, F.lit(cat.name))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def tokens(c: Column) -> Column:
    """Lower-case words split at blanks; no empty words."""
    return F.filter(F.split(collapse_blanks(F.lower(F.coalesce(c, F.lit("")))), " "), lambda w: w != "")


def hash60(c: Column) -> Column:
    """A 60-bit number from md5, the same on every engine that has md5."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 15), 16, 10).cast("bigint")


def seeded_key(seed: int, c: Column) -> Column:
    """Pseudo-random sort key of a row: md5 of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))
