"""Regression metrics per group, with optional row weights.

Error metrics are plain aggregates. Rank metrics work on distinct weighted (truth, prediction) pairs; a
group that fits one task is ranked there, a larger one goes through distributed order statistics.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propspark.operators.ordered import GROUP_ROWS_PER_TASK, centred_ranks, has_large_groups, join_counted, running_total
from propspark.session import broadcast_if_small, cut_lineage

ERROR_METRICS = ("rmse", "mse", "mae")
SPREAD_METRICS = ("r2", "rae")
SPEARMAN_METRICS = ("spearman_rho", "spearman_pvalue")
KENDALL_METRICS = ("kendall_tau", "kendall_tau_pvalue")
METRICS = ERROR_METRICS + SPREAD_METRICS + SPEARMAN_METRICS + KENDALL_METRICS
BUCKETS = 256
# Rows that one task solves at a time where buckets are many and small.
BATCH_ROWS = 200_000


# ---- rank statistics of one bounded group, in numpy -------------------------------------------------


def whole_dot(a: np.ndarray, b: np.ndarray) -> int:
    """The exact sum of products of whole numbers (int64), in limbs of 20 bits where 64 bits might not hold it."""
    if not len(a):
        return 0
    if float(np.abs(a).max()) * float(np.abs(b).max()) * len(a) < 2.0**62:
        return int(a @ b)
    if len(a) > 1 << 20:
        return sum(whole_dot(a[i : i + (1 << 20)], b[i : i + (1 << 20)]) for i in range(0, len(a), 1 << 20))
    limbs = lambda v: [(v >> s) & ((1 << 20) - 1) if s < 60 else v >> s for s in (0, 20, 40, 60)]
    return sum(int(p @ q) << 20 * (i + j) for i, p in enumerate(limbs(a)) for j, q in enumerate(limbs(b)))


def _whole(w: np.ndarray) -> bool:
    return bool((w == np.floor(w)).all() and np.abs(w).sum() < 2.0**53)


def _dot(a: np.ndarray, b: np.ndarray) -> int | float:
    return whole_dot(a, b) if a.dtype == np.int64 else float(a @ b)


def net_order(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> int | float:
    """Weighted concordant minus discordant pairs; pairs tied in x or y count nothing. Exact for whole weights.

    Sorted by x, the pairs are split by block halves of doubling width; each level looks all right-half
    rows up among the left-half rows of their block at once.
    """
    n = len(x)
    if n < 2:
        return 0
    order = np.lexsort((y, x))
    x, w = x[order], w[order].astype(np.int64 if _whole(w) else np.float64)
    yr = np.unique(y, return_inverse=True)[1][order].astype(np.int64)
    m = int(yr.max()) + 1
    at = np.arange(n)
    total, width = 0, 1
    while width < n:
        pair = at // (2 * width)
        key = pair * m + yr
        right = (at // width) % 2 == 1
        lk, lw = key[~right], w[~right]
        by_key = np.argsort(lk, kind="stable")
        lk = lk[by_key]
        cum = np.concatenate([np.zeros(1, w.dtype), np.cumsum(lw[by_key])])
        base = pair[right] * m
        less = cum[np.searchsorted(lk, key[right], "left")] - cum[np.searchsorted(lk, base, "left")]
        more = cum[np.searchsorted(lk, base + m, "left")] - cum[np.searchsorted(lk, key[right], "right")]
        total += _dot(w[right], less - more)
        width *= 2
    # Within one x, rows came in y order and were counted as concordant; take them out again.
    edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    per_x = np.add.reduceat(w, edge)
    edge_xy = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (yr[1:] != yr[:-1])]))
    per_xy = np.add.reduceat(w, edge_xy)
    tied = _dot(per_x, per_x) - _dot(per_xy, per_xy)
    return total - (tied // 2 if isinstance(tied, int) else tied / 2.0)


def net_orders(g: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> int | float:
    """The sum of ``net_order`` over all groups (values of ``g``), without a step for each group.

    Rows are put in order by group and x. Where the halves of a block meet, one group at most lies on both sides,
    so only its rows in the block are looked up.
    """
    n = len(x)
    if n < 2:
        return 0
    if _whole(w) and float(w.sum()) ** 2 >= 2.0**62:
        by_group = np.argsort(g, kind="stable")
        return sum(net_order(x[i], y[i], w[i]) for i in np.split(by_group, np.flatnonzero(np.diff(g[by_group])) + 1))
    order = np.lexsort((y, x, g))
    g, x, w = g[order], x[order], w[order].astype(np.int64 if _whole(w) else np.float64)
    yr = np.unique(y, return_inverse=True)[1][order].astype(np.int64)
    m = int(yr.max()) + 1
    at = np.arange(n)
    total, width = w.dtype.type(0), 1
    while width < n:
        mid = at // (2 * width) * (2 * width) + width
        seam = np.minimum(mid, n - 1)
        rows = np.flatnonzero((mid < n) & (g == g[seam]) & (g == g[seam - 1]))
        right = rows >= mid[rows]
        base = rows // (2 * width) * m
        key = base + yr[rows]
        lk, lw = key[~right], w[rows[~right]]
        by_key = np.argsort(lk, kind="stable")
        lk = lk[by_key]
        cum = np.concatenate([np.zeros(1, w.dtype), np.cumsum(lw[by_key])])
        less = cum[np.searchsorted(lk, key[right], "left")] - cum[np.searchsorted(lk, base[right], "left")]
        more = cum[np.searchsorted(lk, base[right] + m, "left")] - cum[np.searchsorted(lk, key[right], "right")]
        total += w[rows[right]] @ (less - more)
        width *= 2
    new_x = np.concatenate([[True], (g[1:] != g[:-1]) | (x[1:] != x[:-1])])
    per_x = np.add.reduceat(w, np.flatnonzero(new_x))
    per_xy = np.add.reduceat(w, np.flatnonzero(new_x | np.concatenate([[True], yr[1:] != yr[:-1]])))
    tied = per_x @ per_x - per_xy @ per_xy
    return int(total) - int(tied) // 2 if w.dtype == np.int64 else float(total - tied / 2.0)


def net_order_cells(i: np.ndarray, j: np.ndarray, c: np.ndarray) -> int | float:
    """The same over a table of bucket counts, for pairs that differ in both buckets."""
    iu, ii = np.unique(i, return_inverse=True)
    ju, jj = np.unique(j, return_inverse=True)
    c = c.astype(np.int64 if _whole(c) else np.float64)
    grid = np.zeros((len(iu), len(ju)), c.dtype)
    np.add.at(grid, (ii, jj), c)
    above = np.cumsum(grid, axis=0) - grid
    left = np.cumsum(above, axis=1)
    less = left - above
    more = left[:, -1:] - left
    return _dot(grid.ravel(), (less - more).ravel())


def _clip(c: Column) -> Column:
    """Into [-1, 1] against rounding; ``least`` would turn null into a bound."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0)))


# ---- Kendall --------------------------------------------------------------------------------------


def _null_safe(a: DataFrame, b: DataFrame, keys: list[str], tag: str) -> list[Column]:
    return [a[k].eqNullSafe(b[f"{tag}{k}"]) for k in keys]


def _tag(df: DataFrame, keys: list[str], tag: str, *cols: str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"{tag}{k}") for k in keys], *cols)


# Pair counts of whole weights; 10^15 rows have less than 10^30 pairs.
PAIRS = T.DecimalType(38, 0)


def _pairs(n: int | float, whole: bool) -> Decimal | float:
    return Decimal(int(n)) if whole else float(n)


def _per_group(df: DataFrame, keys: list[str], fn, whole: bool) -> DataFrame:
    """Run ``fn(pdf)``, a count of pairs, for every (bounded) group."""
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("s", PAIRS if whole else T.DoubleType())])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, _pairs(fn(pdf), whole)]], columns=[*keys, "s"])

    return df.groupBy(*keys).applyInPandas(run, schema)


def _buckets(dist: DataFrame, keys: list[str], col: str, name: str) -> DataFrame:
    """Monotone bucket number of every distinct value, so that a group falls into about 2 * BUCKETS
    buckets of similar row count; a value with very many rows gets a bucket of its own (odd number)."""
    vals = dist.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_c"))
    cum = running_total(vals, [*keys, col], "_c", "_cum")
    span = cum.groupBy(*keys).agg(F.min("_cum").alias("_s"), F.sum("_c").alias("_n"))
    span = broadcast_if_small(_tag(span, keys, "_g_", "_s", "_n"))
    size = F.ceil(F.col("_n") / BUCKETS)
    at = cum.join(span, _null_safe(cum, span, keys, "_g_"))
    num = 2 * F.floor((F.col("_cum") - F.col("_s")) / size) + (F.col("_c") >= size).cast("bigint")
    return at.select(*keys, col, "_c", num.alias(name))


def _net_of_groups(dist: DataFrame, keys: list[str], cuts: list[str], batches: int, whole: bool) -> DataFrame:
    """``keys, s`` summed over the groups of ``cuts``, each of which fits a task; many small ones are solved together."""
    schema = T.StructType([*[dist.schema[k] for k in keys], T.StructField("s", PAIRS if whole else T.DoubleType())])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf.groupby(cuts, sort=False).ngroup().to_numpy() if cuts else np.zeros(len(pdf), np.int64)
        s = net_orders(g, *(pdf[c].to_numpy(dtype=float) for c in ("_x", "_y", "_w")))
        return pd.DataFrame([[*key[:-1], _pairs(s, whole)]], columns=[*keys, "s"])

    batch = F.pmod(F.xxhash64(*cuts), F.lit(batches)).cast("int") if cuts else F.lit(0)
    return dist.withColumn("_batch", batch).groupBy(*keys, "_batch").applyInPandas(run, schema)


def _net(dist: DataFrame, keys: list[str], leaf: int, whole: bool, cuts: tuple[str, ...] = ()) -> DataFrame:
    """``keys, s`` with s the weighted concordant minus discordant pairs of distinct (x, y, w) rows that agree in ``cuts``.

    Groups beyond ``leaf`` rows are cut into buckets of x and of y. Pairs that differ in both buckets come
    from the table of cell counts; the others are pairs within an x bucket, plus pairs within a y bucket,
    minus pairs within both, each solved by the same function on much smaller groups. Exact.
    """
    inner = [*keys, *cuts]
    sizes = dist.groupBy(*inner).count().groupBy(*keys).agg(F.sum("count").alias("n"), F.max("count").alias("most"))
    rows, most = sizes.agg(F.max("n"), F.max("most")).first()
    if (most or 0) <= leaf:
        return _net_of_groups(dist, keys, list(cuts), math.ceil((rows or 1) / BATCH_ROWS), whole).groupBy(*keys).agg(
            F.sum("s").cast(PAIRS if whole else "double").alias("s"))
    d = len(inner)
    bx, by = f"_bx{d}", f"_by{d}"
    placed = join_counted(dist, _buckets(dist, inner, "_x", bx), [*inner, "_x"], {bx: bx}, "_c")
    placed = cut_lineage(join_counted(placed, _buckets(dist, inner, "_y", by), [*inner, "_y"], {by: by}, "_c"))
    cells = placed.groupBy(*inner, bx, by).agg(F.sum("_w").alias("_w"))
    cross = _per_group(cells, inner, lambda p: net_order_cells(p[bx].to_numpy(), p[by].to_numpy(), p["_w"].to_numpy()), whole)
    # A bucket with a single value has only tied pairs.
    many_x, many_y = F.col(bx) % 2 == 0, F.col(by) % 2 == 0
    in_x = _net(placed.filter(many_x), keys, leaf, whole, (*cuts, bx))
    in_y = _net(placed.filter(many_y), keys, leaf, whole, (*cuts, by))
    in_both = _net(placed.filter(many_x & many_y), keys, leaf, whole, (*cuts, bx, by))
    out = cross.select(*keys, "s")
    for p in (in_x, in_y, in_both.withColumn("s", (-F.col("s")).cast(PAIRS if whole else "double"))):
        out = out.unionByName(p.select(*keys, "s"))
    return out.groupBy(*keys).agg(F.sum("s").cast(PAIRS if whole else "double").alias("s"))


TIES = ("_n", "_tie_x", "_tie_y", "_t0_x", "_t0_y", "_t1_x", "_t1_y")
MOMENTS = ("_sxy", "_sxx", "_syy")


def rank_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, kendall: bool = True) -> list[float]:
    """All sums behind rho and tau of one bounded group: net order (0 where tau is not asked for), size, tie terms, rank moments."""
    sums, ranks = {}, {}
    n = float(w.sum())
    for tag, v in (("_x", x), ("_y", y)):
        _, at = np.unique(v, return_inverse=True)
        t = np.bincount(at, weights=w)
        ranks[tag] = (np.cumsum(t) - (t - 1) / 2.0)[at] - (n + 1) / 2.0
        whole = t.astype(np.int64) if _whole(t) else t
        pairs = _dot(whole, whole - 1)
        sums[f"_tie{tag}"], sums[f"_t0{tag}"] = pairs // 2 if isinstance(pairs, int) else pairs / 2, np.sum(t * (t - 1) * (t - 2))
        sums[f"_t1{tag}"] = np.sum(t * (t - 1) * (2 * t + 5))
    rx, ry = ranks["_x"], ranks["_y"]
    sums |= {"_n": n, "_sxy": np.sum(w * rx * ry), "_sxx": np.sum(w * rx * rx), "_syy": np.sum(w * ry * ry)}
    return [net_order(x, y, w) if kendall else 0, *[sums[c] if c.startswith("_tie") else float(sums[c]) for c in (*TIES, *MOMENTS)]]


def _rank_sums_small(dist: DataFrame, keys: list[str], kendall: bool, whole: bool) -> DataFrame:
    """One shuffle for all rank metrics of groups that fit a task."""
    out = ["s", *TIES, *MOMENTS]
    exact = {"s", "_tie_x", "_tie_y"} if whole else set()
    schema = T.StructType([*[dist.schema[k] for k in keys], *[T.StructField(c, PAIRS if c in exact else T.DoubleType()) for c in out]])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sums = rank_sums(*(pdf[c].to_numpy(dtype=float) for c in ("_x", "_y", "_w")), kendall)
        return pd.DataFrame([[*key, *[_pairs(v, c in exact) for c, v in zip(out, sums)]]], columns=[*keys, *out])

    return dist.groupBy(*keys).applyInPandas(run, schema)


def _rank_sums_large(dist: DataFrame, keys: list[str], leaf: int, kendall: bool, spearman: bool, whole: bool) -> DataFrame:
    """The same sums from distributed order statistics."""
    out = dist.groupBy(*keys).agg(F.sum("_w").cast("double").alias("_n"))
    parts = [_tie_terms(dist, keys, "_x", whole), _tie_terms(dist, keys, "_y", whole), _net(dist, keys, leaf, whole)] if kendall else []
    parts += [_rank_moments(dist, keys)] if spearman else []
    for i, part in enumerate(parts):
        side = _tag(part, keys, f"_p{i}_", *[c for c in part.columns if c not in keys])
        out = out.join(side, _null_safe(out, side, keys, f"_p{i}_")).drop(*[f"_p{i}_{k}" for k in keys])
    return out


def _tie_terms(dist: DataFrame, keys: list[str], col: str, whole: bool) -> DataFrame:
    t = F.col("_t").cast("double")
    # Twice the pairs are a whole number; half their sum is one again.
    n = F.col("_t").cast("decimal(17,0)")
    tied = (F.sum(n * (n - 1)) / 2).cast(PAIRS) if whole else F.sum(t * (t - 1) / 2)
    per_value = dist.groupBy(*keys, col).agg(F.sum("_w").alias("_t"))
    return per_value.groupBy(*keys).agg(
        tied.alias(f"_tie{col}"),
        F.sum(t * (t - 1) * (t - 2)).alias(f"_t0{col}"),
        F.sum(t * (t - 1) * (2 * t + 5)).alias(f"_t1{col}"),
    )


def _rank_moments(dist: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of products of the centred ranks; groups go by a number, and rows are sorted twice, once for each side."""
    groups = cut_lineage(dist.select(*keys).distinct().withColumn("_g", F.monotonically_increasing_id()))
    side = broadcast_if_small(_tag(groups, keys, "_g_", "_g"))
    rows = dist.join(side, _null_safe(dist, side, keys, "_g_")).select("_g", "_x", "_y", "_w")
    rows = centred_ranks(rows, "_g", "_x", "_w", "_r_x", ["_y"])
    rows = centred_ranks(rows.drop("_x"), "_g", "_y", "_w", "_r_y", ["_r_x"])
    w, dx, dy = F.col("_w").cast("double"), F.col("_r_x"), F.col("_r_y")
    sums = rows.groupBy("_g").agg(F.sum(w * dx * dy).alias("_sxy"), F.sum(w * dx * dx).alias("_sxx"), F.sum(w * dy * dy).alias("_syy"))
    return groups.join(sums, "_g").drop("_g")


def _kendall_exact_p(n: int, discordant: int) -> float:
    """Two-sided p-value from the exact distribution of inversions of n untied rows."""
    pairs = n * (n - 1) // 2
    c = min(discordant, pairs - discordant)
    if 2 * c >= pairs:
        return 1.0
    if c <= 1:
        # One order has no inversion and n - 1 have one.
        return min(1.0, 2.0 * (n if c else 1) * math.exp(-math.lgamma(n + 1)))
    ways = [1.0]
    for size in range(2, n + 1):
        run, nxt = 0.0, []
        for at in range(min(c, size * (size - 1) // 2) + 1):
            run += ways[at] if at < len(ways) else 0.0
            run -= ways[at - size] if 0 <= at - size < len(ways) else 0.0
            nxt.append(run / size)
        ways = nxt
    return min(1.0, 2.0 * sum(ways[: c + 1]))


def _kendall_p(s, n, xt, yt, x0, y0, x1, y1) -> float:
    """Exact without ties for at most 33 rows or one inversion (a fixed rule of the usual library), else normal."""
    pairs = n * (n - 1) / 2
    if n < 2 or xt >= pairs or yt >= pairs:
        return 1.0
    if xt == 0 and yt == 0:
        dis = round((pairs - s) / 2)
        if n <= 33 or min(dis, pairs - dis) <= 1:
            return _kendall_exact_p(int(n), int(dis))
    m = n * (n - 1.0)
    var = (m * (2 * n + 5) - x1 - y1) / 18 + 2 * xt * yt / m + (x0 * y0 / (9 * m * (n - 2)) if n > 2 else 0.0)
    return math.erfc(abs(s) / math.sqrt(var) / math.sqrt(2)) if var > 0 else 1.0


@F.pandas_udf(T.DoubleType())
def _kendall_p_udf(s: pd.Series, n: pd.Series, xt: pd.Series, yt: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    return pd.Series([_kendall_p(*v) for v in zip(s, n, xt, yt, x0, y0, x1, y1)], dtype="float64")


# ---- Spearman -------------------------------------------------------------------------------------


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz's method)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(T.DoubleType())
def _spearman_p_udf(rho: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided t-test with n - 2 degrees of freedom; undefined correlations give 1."""

    def one(r, k):
        if r is None or r != r or k < 3:
            return 1.0
        return incomplete_beta((k - 2) / 2.0, 0.5, max(0.0, 1.0 - r * r))

    return pd.Series([one(r, k) for r, k in zip(rho, n)], dtype="float64")


def _rank_metrics(dist: DataFrame, keys: list[str], leaf: int, metrics: list[str], whole: bool) -> DataFrame:
    kendall, spearman = bool(set(KENDALL_METRICS) & set(metrics)), bool(set(SPEARMAN_METRICS) & set(metrics))
    large = has_large_groups(dist, keys, leaf)
    sums = _rank_sums_large(dist, keys, leaf, kendall, spearman, whole) if large else _rank_sums_small(dist, keys, kendall, whole)
    cols = []
    if spearman:
        rho = _clip(F.try_divide(F.col("_sxy"), F.sqrt("_sxx") * F.sqrt("_syy")))
        sums = sums.withColumn("spearman_rho", rho)
        cols.append("spearman_rho")
        if "spearman_pvalue" in metrics:
            sums = sums.withColumn("spearman_pvalue", _spearman_p_udf("spearman_rho", "_n"))
            cols.append("spearman_pvalue")
    if kendall:
        # Counts of pairs are subtracted as whole numbers; what is left becomes a double.
        n = F.col("_n").cast("decimal(17,0)") if whole else F.col("_n")
        free = lambda c: (n * (n - 1) / 2 - F.col(c)).cast("double")
        tau = F.try_divide(F.col("s").cast("double"), F.sqrt(free("_tie_x")) * F.sqrt(free("_tie_y")))
        sums = sums.withColumn("kendall_tau", _clip(tau))
        cols.append("kendall_tau")
        if "kendall_tau_pvalue" in metrics:
            p = _kendall_p_udf(*[F.col(c).cast("double") for c in ("s", "_n", "_tie_x", "_tie_y", "_t0_x", "_t0_y", "_t1_x", "_t1_y")])
            sums = sums.withColumn("kendall_tau_pvalue", p)
            cols.append("kendall_tau_pvalue")
    return sums.select(*keys, *cols)


# ---- all together ---------------------------------------------------------------------------------


def metric_table(
    df: DataFrame,
    y: str,
    p: str,
    *,
    metrics: Iterable[str] = METRICS,
    by: Iterable[str] = (),
    weight: str | None = None,
    undefined_as_zero: bool = True,
    leaf: int = GROUP_ROWS_PER_TASK,
) -> DataFrame:
    """One row per group with the metrics asked for.

    ``undefined_as_zero`` is the model-scoring rule: R2 of a constant target and correlations of a constant
    side are 0. Without it they are null (the evaluation rule). Undefined p-values are 1 in both.
    Rows with a missing truth or prediction are left out. Without weights, or with whole ones, pairs of rows are
    counted exactly at any size.
    """
    metrics = list(metrics)
    unknown = set(metrics) - set(METRICS)
    if unknown:
        raise ValueError(f"unknown metric: {sorted(unknown)}")
    keys = list(by) or ["_all"]
    src = df if by else df.withColumn("_all", F.lit(0))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = src.select(
        *keys, F.col(y).cast("double").alias("_x"), F.col(p).cast("double").alias("_y"), w.alias("_w")
    ).filter(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    ranked = bool(set(SPEARMAN_METRICS + KENDALL_METRICS) & set(metrics))
    if ranked:
        # Rank metrics read the rows many times; all metrics then use the stored distinct pairs.
        rows = cut_lineage(rows.groupBy(*keys, "_x", "_y").agg(F.sum("_w").alias("_w")).filter("_w > 0"))
    ww, err = F.col("_w"), F.col("_x") - F.col("_y")
    # Without weights the spread of the truth comes from the same pass; only absolute deviations need the mean first.
    one_pass = [] if weight or ranked else [(F.var_pop("_x") * F.count("_x")).alias("_sst")]
    base = rows.groupBy(*keys).agg(
        F.sum(ww).alias("_n"), (F.sum(ww * F.col("_x")) / F.sum(ww)).alias("_mean"),
        (F.sum(ww * err * err) / F.sum(ww)).alias("mse"), (F.sum(ww * F.abs(err)) / F.sum(ww)).alias("mae"), *one_pass,
    ).withColumn("rmse", F.sqrt("mse"))
    out = base
    second = "rae" in metrics or ("r2" in metrics and not one_pass)
    if second:
        out = base = cut_lineage(base)
        side = broadcast_if_small(_tag(base, keys, "_g_", "_mean"))
        dev = F.col("_x") - F.col("_mean")
        more = [F.sum(ww * F.abs(dev)).alias("_sad"), *([] if one_pass else [F.sum(ww * dev * dev).alias("_sst")])]
        spread = rows.join(side, _null_safe(rows, side, keys, "_g_")).groupBy(*keys).agg(*more)
        spread = _tag(spread, keys, "_s_", *[c for c in spread.columns if c not in keys])
        out = out.join(spread, _null_safe(out, spread, keys, "_s_")).drop(*[f"_s_{k}" for k in keys])
        if "rae" in metrics:
            out = out.withColumn("rae", F.try_divide(F.col("mae") * F.col("_n"), F.col("_sad")))
    if "r2" in metrics:
        r2 = F.lit(1.0) - F.try_divide(F.col("mse") * F.col("_n"), F.col("_sst"))
        out = out.withColumn("r2", F.coalesce(r2, F.lit(0.0)) if undefined_as_zero else r2)
    if ranked:
        whole = weight is None or isinstance(df.schema[weight].dataType, T.IntegralType)
        part = _rank_metrics(rows, keys, leaf, metrics, whole)
        cols = [c for c in part.columns if c not in keys]
        part = _tag(part, keys, "_j_", *cols)
        out = out.join(part, _null_safe(out, part, keys, "_j_"), "left")
        for c in cols:
            if c.endswith("pvalue"):
                out = out.withColumn(c, F.coalesce(F.col(c), F.lit(1.0)))
            elif undefined_as_zero:
                out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0.0)))
    return out.select(*list(by), F.col("_n").cast("bigint").alias("n"), *metrics)
