"""Exact order statistics without a single-partition window.

Rows are range-partitioned on the order columns and sorted in place; each partition then needs only
the total of the partitions before it. A hot value cannot overload a task: equal values are merged to
one weighted row first, and positions are broken by further order columns.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propspark.session import broadcast_if_small, cut_lineage
from propspark.sources.tables import is_empty

# Groups up to this many rows may be handled inside one task.
GROUP_ROWS_PER_TASK = 1_000_000
# Rows of a range that one task sorts and ranks, about; ranges are at least as many as the cores.
RANGE_ROWS = 250_000


def _as_cols(order: Iterable[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _range_sorted(df: DataFrame, order: list[Column]) -> DataFrame:
    """Globally sorted rows, fixed on reliable storage, with partition number and position in it.

    No partition count is given, so AQE may merge neighbouring ranges of a small table; order is kept.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    fixed = cut_lineage(placed.withColumn("_at", F.monotonically_increasing_id()))
    # The id holds the partition in its upper 31 bits and the position in its lower 33.
    return fixed.withColumn("_part", F.shiftright("_at", 33)).withColumn(
        "_pos", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    )


def _offsets(sized: DataFrame) -> DataFrame:
    """Running total over partitions: one row per partition, so the one-task window stays tiny."""
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sized.select("_part", F.coalesce(F.sum("_size").over(w), F.lit(0)).alias("_off"))


def global_index(df: DataFrame, order: Iterable[str | Column], name: str = "row_idx") -> DataFrame:
    """Add the 0-based position of each row in the total order."""
    rows = _range_sorted(df, _as_cols(order))
    offsets = _offsets(rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_size")))
    return (
        rows.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_off") + F.col("_pos"))
        .drop("_part", "_off", "_at", "_pos")
    )


def cut_keys(df: DataFrame, number: Column, order: list[Column], ranks: Iterable[int], *, accuracy: int = 20_000, limit: int = 100_000) -> list[tuple]:
    """The order key at each 0-based rank of the total order, by three passes over the key columns alone.

    ``number`` is a whole number that never falls along ``order``. A mergeable quantile sketch brackets every
    rank, a second pass counts the rows below and in each bracket exactly, and the rows in the brackets, of which
    the sketch leaves a share of about 4 / ``accuracy`` for each rank, are sorted on the driver. A bracket that missed is
    opened to the whole range; one that holds more than ``limit`` rows, as where many share a number, is sorted
    in Spark. No row of ``df`` is moved, and a row's key is computed once in a pass.
    """
    names = [f"_o{i}" for i in range(len(order))]
    keys = df.select(number.alias("_n"), *[c.alias(n) for c, n in zip(order, names)])
    ranks = list(ranks)
    wanted = sorted(set(ranks))
    if not wanted:
        return []
    total = df.count()
    shares = [min(1.0, max(0.0, (r + 0.5) / total + d / accuracy)) for r in wanted for d in (-2, 2)]
    low, high, ends = keys.agg(F.min("_n"), F.max("_n"), F.approx_percentile("_n", shares, accuracy)).first()
    around = {}
    for i, rank in enumerate(wanted):
        # The sketch works in doubles, so a few units are added at either side.
        lo, hi = (int(v) for v in ends[2 * i : 2 * i + 2])
        around[rank] = max(low, lo - abs(lo) // (1 << 50) - 1), min(high, hi + abs(hi) // (1 << 50) + 1)
    below = _counted(keys, around)
    missed = [r for r in wanted if not below[r][0] <= r < below[r][0] + below[r][1]]
    for r in missed:
        around[r], below[r] = (low, high), (0, total)
    found: dict[int, tuple] = {}
    near = []
    for rank in wanted:
        if below[rank][1] * len(wanted) <= limit or total <= limit:
            near.append(rank)
            continue
        own = keys.filter(F.col("_n").between(*around[rank])).select(*names)
        found[rank] = tuple(global_index(own, names, "_at").filter(F.col("_at") == rank - below[rank][0]).select(*names).first())
    if near:
        # Rows of the brackets, without a filter that would compute the key anew for each comparison.
        inside = sum(((F.col("_n") >= lo) & (F.col("_n") <= hi)).cast("int") for lo, hi in (around[r] for r in near)) > 0
        rows = keys.select(F.inline(F.when(inside, F.array(F.struct("_n", *names))).otherwise(F.array().cast(keys.select(F.array(F.struct("_n", *names))).schema[0].dataType))))
        rows = rows.orderBy(*names).collect()
        numbers = [r["_n"] for r in rows]
        for rank in near:
            found[rank] = tuple(rows[bisect_left(numbers, around[rank][0]) + rank - below[rank][0]])[1:]
    return [found[r] for r in ranks]


def _counted(keys: DataFrame, around: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """Per rank the rows below its bracket and in it."""
    sums = []
    for lo, hi in around.values():
        sums += [F.count_if(F.col("_n") < lo), F.count_if(F.col("_n").between(lo, hi))]
    got = keys.agg(*sums).first()
    return {rank: (got[2 * i], got[2 * i + 1]) for i, rank in enumerate(around)}


def in_pieces(df: DataFrame, number: Column, order: list[Column], starts: Iterable[int], name: str) -> DataFrame:
    """Add into which run of the total order a row falls, runs beginning at the given ranks (above 0): a number from 0.

    The cuts become constants, so the rows stay where they are. The order should be total (unique ids).
    """
    cuts = cut_keys(df, number, order, starts)
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.select("*", *[c.alias(n) for c, n in zip(order, names)])
    key = F.struct(*names)
    run = sum(((key >= F.struct(*[F.lit(v).alias(n) for n, v in zip(names, cut)])).cast("int") for cut in cuts), F.lit(0))
    return keyed.withColumn(name, run).drop(*names)


def running_total(df: DataFrame, order: Iterable[str | Column], weight: str, name: str) -> DataFrame:
    """Add the sum of ``weight`` over all rows that come earlier in the total order."""
    cols = _as_cols(order)
    rows = _range_sorted(df, cols)
    offsets = _offsets(rows.groupBy("_part").agg(F.sum(weight).alias("_size")))
    w = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_in", F.coalesce(F.sum(weight).over(w), F.lit(0)))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_off") + F.col("_in"))
        .drop("_part", "_off", "_at", "_pos", "_in")
    )


def has_large_groups(df: DataFrame, by: Iterable[str], limit: int = GROUP_ROWS_PER_TASK) -> bool:
    """Whether any group is too large for one task; a counting pass with map-side combine."""
    by = list(by)
    counted = df.groupBy(*by).count() if by else df.agg(F.count(F.lit(1)).alias("count"))
    return not is_empty(counted.filter(F.col("count") > limit))


def _interpolated(group: DataFrame, keys: list[str], col: str, probs: dict[str, float]) -> DataFrame:
    """Quantiles of every group by range-sorted positions of weighted distinct values."""
    dist = group.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_w"))
    cum = running_total(dist, [*keys, col], "_w", "_cum")
    span = cum.groupBy(*keys).agg(F.min("_cum").alias("_start"), F.sum("_w").alias("_n"))
    span = broadcast_if_small(span.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_start", "_n"))
    on = [cum[k].eqNullSafe(span[f"_k_{k}"]) for k in keys]
    at = cum.join(span, on).withColumn("_first", F.col("_cum") - F.col("_start"))
    aggs = []
    for name, p in probs.items():
        h = (F.col("_n") - 1) * F.lit(float(p))
        holds = lambda pos: (F.col("_first") <= pos) & (pos < F.col("_first") + F.col("_w"))
        aggs += [
            F.max(F.when(holds(F.floor(h)), F.col(col))).cast("double").alias(f"_lo_{name}"),
            F.max(F.when(holds(F.ceil(h)), F.col(col))).cast("double").alias(f"_hi_{name}"),
            F.max(h - F.floor(h)).alias(f"_f_{name}"),
        ]
    picked = at.groupBy(*keys).agg(*aggs)
    return picked.select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
            for n in probs
        ],
    )


def quantiles(df: DataFrame, col: str, probs: dict[str, float], by: Iterable[str] = (), *, group_rows: int = GROUP_ROWS_PER_TASK) -> DataFrame:
    """Exact linear-interpolated quantiles, one row per group.

    Small groups use the built-in percentile; a group with more than ``group_rows`` rows goes through a
    distributed sort. Both are exact.
    """
    by = list(by)
    rows = df.select(*by, col).filter(F.col(col).isNotNull())
    builtin = [F.percentile(col, F.lit(float(p))).alias(n) for n, p in probs.items()]
    if not by:
        keyed = rows.withColumn("_all", F.lit(0))
        if not has_large_groups(rows, [], group_rows):
            return rows.agg(*builtin)
        return _interpolated(keyed, ["_all"], col, probs).drop("_all")
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.filter(F.col("_n") > group_rows).drop("_n")
    if is_empty(large):
        return rows.groupBy(*by).agg(*builtin)
    side = broadcast_if_small(large.select(*[F.col(k).alias(f"_l_{k}") for k in by]))
    on = [rows[k].eqNullSafe(side[f"_l_{k}"]) for k in by]
    small_part = rows.join(side, on, "left_anti").groupBy(*by).agg(*builtin)
    large_part = _interpolated(rows.join(side, on, "left_semi"), by, col, probs)
    return small_part.unionByName(large_part)


def average_ranks(df: DataFrame, col: str, weight: str, by: Iterable[str] = ()) -> DataFrame:
    """Rank table of distinct values with ties averaged: group keys, value, ``rank`` and ``ties``.

    Works on distinct values only, so its size is that of the value set.
    """
    by = list(by)
    keys = by or ["_all"]
    src = df if by else df.withColumn("_all", F.lit(0))
    dist = src.groupBy(*keys, col).agg(F.sum(weight).alias("ties"))
    cum = running_total(dist, [*keys, col], "ties", "_cum")
    start = broadcast_if_small(cum.groupBy(*keys).agg(F.min("_cum").alias("_start")).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], "_start"))
    out = cum.join(start, [cum[k].eqNullSafe(start[f"_k_{k}"]) for k in keys])
    out = out.withColumn("rank", F.col("_cum") - F.col("_start") + (F.col("ties") + 1) / 2)
    return out.select(*by, col, "rank", "ties")


def centred_ranks(df: DataFrame, group: str, col: str, weight: str, name: str, ties: Iterable[str] = ()) -> DataFrame:
    """Add the average rank of ``col`` (doubles) within ``group`` (whole numbers), less the group's mean rank; neither is null.

    Rows are dealt to ranges once and ranked there, so neither a table of values nor a join of all rows with it
    is made. ``ties`` are further columns of the order: rows of a hot value then fall to many ranges. A range knows its
    values' weights and what lies before them in it; the few values that reach an end of a range are summed up over ranges.
    """
    order = [group, col, *ties]
    ranges = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / RANGE_ROWS))
    placed = df.repartitionByRange(ranges, *order).withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*placed.schema, T.StructField("_low", T.DoubleType()), T.StructField("_own", T.DoubleType()), T.StructField("_end", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        # Spark has dealt the ranges; inside one, numpy sorts faster than row comparisons. Rows of a value may lie in any order.
        rows = rows.take(np.lexsort((rows.column(col).to_numpy(), rows.column(group).to_numpy())))
        g, v, w = (rows.column(c).to_numpy() for c in (group, col, weight))
        new_group = np.concatenate([[True], g[1:] != g[:-1]])
        new = new_group | np.concatenate([[True], (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))])
        first = np.flatnonzero(new)
        before = np.concatenate([[0.0], np.cumsum(w[:-1], dtype=float)])
        low = before[first] - before[np.maximum.accumulate(np.where(new_group, np.arange(len(g)), 0))[first]]
        end = np.zeros(len(first), bool)
        end[[0, -1]] = True
        at = np.cumsum(new) - 1
        for c, of in (("_low", low), ("_own", np.add.reduceat(w.astype(float), first)), ("_end", end)):
            rows = rows.append_column(c, pa.array(of[at]))
        yield from rows.to_batches(max_chunksize=1 << 16)

    fixed = cut_lineage(placed.mapInArrow(run, schema))
    inside = Window.partitionBy(group)
    shares = fixed.groupBy(group, "_part").agg(F.sum(F.col(weight).cast("double")).alias("_size"))
    shares = cut_lineage(shares.select(
        group, "_part", F.sum("_size").over(inside).alias("_all"),
        F.coalesce(F.sum("_size").over(inside.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_off")))
    # Two values for each range at most.
    ends = fixed.filter("_end").groupBy(group, col, "_part").agg(F.max("_low").alias("_low"), F.max("_own").alias("_own"))
    ends = ends.join(shares, [group, "_part"]).groupBy(group, col).agg(F.min(F.col("_off") + F.col("_low")).alias("_from"), F.sum("_own").alias("_ties"))
    placed = fixed.join(broadcast_if_small(shares), [group, "_part"]).join(F.broadcast(ends), [group, col], "left")
    rank = F.coalesce("_from", F.col("_off") + F.col("_low")) + (F.coalesce("_ties", "_own") + 1) / 2 - (F.col("_all") + 1) / 2
    return placed.select(*df.columns, rank.alias(name))


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], values: dict[str, str], count_col: str, *,
                 hot_rows: int = GROUP_ROWS_PER_TASK, max_hot: int = 1000) -> DataFrame:
    """Bring ``values`` (table column to new name) to every row by a unique key that is never missing.

    ``count_col`` says how many rows share a key. The keys with most rows (at most ``max_hot``, so the
    broadcast is bounded) are joined by broadcast, all others by shuffle: a key that holds a third of all
    rows does not land in one task.
    """
    side_cols = [*[F.col(k).alias(f"_r_{k}") for k in keys], *[F.col(c).alias(n) for c, n in values.items()]]
    drop = [f"_r_{k}" for k in keys]
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    hot = table.filter(F.col(count_col) > hot_rows).orderBy(F.desc(count_col), *keys).limit(max_hot)
    if is_empty(hot):
        return rows.join(broadcast_if_small(table.select(*side_cols)), on).drop(*drop)
    hot = cut_lineage(hot.select(*side_cols))
    hot_keys = F.broadcast(hot.select(*drop))
    first = rows.join(F.broadcast(hot), on)
    rest = rows.join(hot_keys, on, "left_anti").join(table.select(*side_cols), on)
    return first.unionByName(rest).drop(*drop)


def sequential_ids(df: DataFrame, order: Iterable[str | Column], prefix: str, name: str = "mol_id") -> DataFrame:
    """Ids ``prefix1 .. prefixN`` in row order."""
    order = list(order)
    if not order:
        raise ValueError("sequential ids need an order column")
    return (
        global_index(df, order, "_seq")
        .withColumn(name, F.concat(F.lit(prefix), (F.col("_seq") + 1).cast("string")))
        .drop("_seq")
    )


def time_sorted(df: DataFrame, time_col: str, id_col: str, ascending: bool = True) -> DataFrame:
    key = F.to_timestamp(time_col)
    return df.orderBy(key.asc() if ascending else key.desc(), F.col(id_col))
