"""Feature selection and imputation over many columns in one pass."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_stats(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Long table ``feature, null_fraction, variance`` (population variance over present values)."""
    cols = list(cols)
    wide = df.agg(
        *[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(f"n{i}") for i, c in enumerate(cols)],
        *[F.var_pop(F.col(f"`{c}`").cast("double")).alias(f"v{i}") for i, c in enumerate(cols)],
    )
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("null_fraction"), F.col(f"v{i}").alias("variance"))
        for i, c in enumerate(cols)
    ])
    return wide.select(F.inline(rows))


def kept_columns(df: DataFrame, cols: Iterable[str], *, max_null_fraction: float = 0.2, drop_constant: bool = True) -> DataFrame:
    """Columns that survive: null fraction at most the limit, then variance above zero."""
    stats = column_stats(df, cols).filter(F.col("null_fraction") <= max_null_fraction)
    return stats.filter(F.col("variance") > 0) if drop_constant else stats


def prune_columns(df: DataFrame, cols: Iterable[str], **rule) -> tuple[DataFrame, list[str]]:
    """Drop the feature columns that do not survive. Only column names travel to the driver."""
    cols = list(cols)
    keep = {r["feature"] for r in kept_columns(df, cols, **rule).collect()}
    names = [c for c in cols if c in keep]
    return df.drop(*[c for c in cols if c not in keep]), names


def _ordered(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers in the same order; NaN (missing) must be gone."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits >= 0, bits, bits ^ np.int64((1 << 63) - 1)).view(np.uint64) ^ np.uint64(1 << 63)


def _value(key: int) -> float:
    bits = np.uint64(key ^ (1 << 63)).view(np.int64)
    return float((bits if bits >= 0 else bits ^ np.int64((1 << 63) - 1)).view(np.float64))


def _counted(rows: DataFrame, spans: dict[int, tuple[int, int, int]], bins: int) -> dict[int, np.ndarray]:
    """Counts by step of the values inside each target's span (column, first key, step); one pass over the rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {t: np.zeros(bins, np.int64) for t in spans}
        for part in batches:
            keys: dict[int, np.ndarray] = {}
            for t, (c, first, step) in spans.items():
                if c not in keys:
                    v = part.iloc[:, c].to_numpy(float)
                    keys[c] = _ordered(v[~np.isnan(v)])
                at = keys[c][keys[c] >= np.uint64(first)] - np.uint64(first)
                at = at // np.uint64(step)
                total[t] += np.bincount(at[at < bins].astype(np.int64), minlength=bins)
        yield pd.DataFrame({"t": list(total), "n": list(total.values())})

    def add(t: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"t": [t[0]], "n": [np.sum(np.stack(part["n"].to_list()), axis=0)]})

    found = rows.mapInPandas(run, "t int, n array<bigint>").groupBy("t").applyInPandas(add, "t int, n array<bigint>").collect()
    return {r["t"]: np.array(r["n"]) for r in found}


def _inside(rows: DataFrame, spans: dict[int, tuple[int, int, int]]) -> dict[int, np.ndarray]:
    """The sorted keys inside each target's span (column, first key, last key), for spans known to hold few."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for t, (c, first, last) in spans.items():
                v = part.iloc[:, c].to_numpy(float)
                keys = _ordered(v[~np.isnan(v)])
                keys = keys[(keys >= np.uint64(first)) & (keys <= np.uint64(last))]
                if len(keys):
                    out.append((t, keys.view(np.int64)))
            yield pd.DataFrame(out, columns=["t", "keys"])

    got: dict[int, list] = {t: [] for t in spans}
    for r in rows.mapInPandas(run, "t int, keys array<bigint>").collect():
        got[r["t"]].append(np.array(r["keys"], np.int64).view(np.uint64))
    return {t: np.sort(np.concatenate(parts)) for t, parts in got.items()}


def column_medians(df: DataFrame, cols: Iterable[str], *, bins: int = 2048, gather: int = 2048) -> DataFrame:
    """Exact interpolated medians, ``feature, median``; columns without any value (null or NaN) have no row.

    All columns are searched together: a pass counts, for each column, the values in ``bins`` equal steps of the
    range that still holds its middle, in the order of the doubles' bits. Once a range holds at most ``gather``
    values these are brought to the driver. Rows are neither exploded nor moved.
    """
    cols, spark = list(cols), df.sparkSession
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    middle: dict[int, float] = {}
    # Target 2 c is the lower middle of column c, 2 c + 1 the upper one: (first key, last key, values below).
    open_ = {t: (0, (1 << 64) - 1, 0) for t in range(2 * len(cols))}
    size: dict[int, int] = {}
    near: dict[int, tuple[int, int, int]] = {}
    while open_:
        steps = {t: (lo, (hi - lo) // bins + 1) for t, (lo, hi, _) in open_.items()}
        counts = _counted(rows, {t: (t // 2, *steps[t]) for t in open_}, bins)
        after = {}
        for t, (_, hi, below) in open_.items():
            n = counts.get(t, np.zeros(bins, np.int64))
            total = size.setdefault(t // 2, int(n.sum()))
            if not total:
                continue
            rank = (total - 1) // 2 if t % 2 == 0 else total // 2
            upto = below + np.cumsum(n)
            at = int(np.searchsorted(upto, rank, "right"))
            first, step = steps[t]
            span = first + at * step, min(hi, first + (at + 1) * step - 1), int(upto[at] - n[at])
            if span[0] == span[1]:
                middle[t] = _value(span[0])
            elif n[at] <= gather:
                near[t] = (*span[:2], rank - span[2])
            else:
                after[t] = span
        open_ = after
    if near:
        keys = _inside(rows, {t: (t // 2, lo, hi) for t, (lo, hi, _) in near.items()})
        middle |= {t: _value(int(keys[t][at])) for t, (_, _, at) in near.items()}
    found = [(c, (middle[2 * i] + middle[2 * i + 1]) / 2) for i, c in enumerate(cols) if 2 * i in middle]
    return spark.createDataFrame(found, "feature string, median double")


def impute_with(df: DataFrame, medians: dict[str, float], cols: Iterable[str]) -> DataFrame:
    """Fill nulls with fitted medians; columns that had no median are dropped."""
    cols = list(cols)
    gone = [c for c in cols if c not in medians]
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(medians[c])) for c in cols if c in medians}).drop(*gone)


def median_impute(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    cols = list(cols)
    return impute_with(df, {r["feature"]: r["median"] for r in column_medians(df, cols).collect()}, cols)


class BitFrequencySelector:
    """Keep bits whose share of on-rows lies within [min_frac, max_frac]."""

    def __init__(self, min_frac: float = 0.02, max_frac: float = 0.98):
        if not (0.0 <= min_frac <= 1.0 and 0.0 <= max_frac <= 1.0 and min_frac <= max_frac):
            raise ValueError("need 0 <= min_frac <= max_frac <= 1")
        self.min_frac, self.max_frac = min_frac, max_frac
        self._support: DataFrame | None = None

    def fit(self, df: DataFrame, bits_col: str, n_bits: int) -> BitFrequencySelector:
        n = df.agg(F.count(F.lit(1))).scalar()
        on = df.select(F.explode(bits_col).alias("bit")).groupBy("bit").agg(F.count(F.lit(1)).alias("_on"))
        every = df.sparkSession.range(n_bits).select(F.col("id").cast("int").alias("bit"))
        share = every.join(on, "bit", "left").select("bit", (F.coalesce("_on", F.lit(0)) / n).alias("frequency"))
        self._support = share.filter(F.col("frequency").between(self.min_frac, self.max_frac))
        return self

    def support(self) -> DataFrame:
        if self._support is None:
            raise RuntimeError("fit the selector first")
        return self._support

    def transform(self, df: DataFrame, bits_col: str) -> DataFrame:
        """Keep only supported bits in each row and renumber them 0, 1, ... in bit order.

        The support is bounded by the fingerprint width, so it travels as one literal array.
        """
        bits = sorted(r["bit"] for r in self.support().select("bit").collect())
        rank = {b: i for i, b in enumerate(bits)}
        new = F.array(*[F.lit(rank.get(b)).cast("int") for b in range(bits[-1] + 1 if bits else 1)])
        return df.withColumn(bits_col, F.filter(F.transform(F.col(bits_col), lambda b: F.get(new, b)), lambda b: b.isNotNull()))
