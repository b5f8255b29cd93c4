"""Train/validation splits as columns: random, group, derived-key and time folds, and hold-outs.

Folds are numbered from 1. The training side of fold k is simply every row with another number.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propspark.functions.text import seeded_key
from propspark.operators.ordered import global_index, in_pieces, join_counted
from propspark.session import broadcast_if_small
from propspark.sources.tables import require_columns

METHODS = ("random", "group", "scaffold", "time_series")


@dataclass(frozen=True)
class SplitConfig:
    """How rows are divided. ``scaffold`` groups rows by a key computed from the row (``derived_key``)."""

    method: str = "random"
    outer_folds: int = 5
    inner_folds: int = 5
    shuffle: bool = True
    random_state: int = 0
    group_column: str | None = None
    derived_key: str | None = None
    time_column: str | None = None
    time_ascending: bool = True


def _check_size(n: int, k: int) -> None:
    if k < 2:
        raise ValueError("n_splits must be at least 2")
    if k > n:
        raise ValueError(f"n_splits={k} cannot exceed the number of rows ({n})")


def random_folds(df: DataFrame, id_col: str, k: int, *, seed: int = 0, shuffle: bool = True, name: str = "fold") -> DataFrame:
    """Balanced folds over a seeded order of unique ids; the first ``n % k`` folds are one row larger."""
    n = df.count()
    _check_size(n, k)
    size, longer = divmod(n, k)
    starts = [j * size + min(j, longer) for j in range(1, k)]
    if shuffle:
        out = _shuffled_pieces(df, id_col, seed, starts, name)
    elif isinstance(df.schema[id_col].dataType, T.IntegralType):
        # Null ids come first; like the smallest number they are told apart by the order alone.
        out = in_pieces(df, F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), [F.col(id_col)], starts, name)
    else:
        at = F.col("_idx")
        run = sum(((at >= s).cast("int") for s in starts), F.lit(0))
        return global_index(df, [F.col(id_col)], "_idx").withColumn(name, run + 1).drop("_idx")
    return out.withColumn(name, F.col(name) + 1)


def _shuffled_pieces(df: DataFrame, id_col: str, seed: int, starts: list[int], name: str) -> DataFrame:
    """Runs of the seeded order; its key is hexadecimal text, whose first 15 digits are a number."""
    key = seeded_key(seed, F.col(id_col))
    number = F.coalesce(F.conv(F.substring(key, 1, 15), 16, 10).cast("long"), F.lit(-1))
    return in_pieces(df, number, [key, F.col(id_col)], starts, name)


def _timed_pieces(df: DataFrame, time_col: str, id_col: str, ascending: bool, starts: list[int], name: str) -> DataFrame:
    """Runs of the time order; rows without a time come first, or last where the order falls."""
    number = F.coalesce(F.unix_micros(F.to_timestamp(time_col)), F.lit(-(1 << 62)))
    number = number if ascending else -number
    return in_pieces(df, number, [number, F.col(id_col)], starts, name)


def lightest_first_schedule(classes: list[tuple[int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """Where a "next group to the lightest fold" rule sends groups, without walking over the groups.

    ``classes`` holds (group size, number of groups), largest size first. Within one size the rule cycles
    over the folds that are lightest, and a cycle only changes when another fold becomes as light; that
    gives at most ``k`` phases per size. Each phase is (size, first rank, end rank, folds in turn).
    """
    loads = [0] * k
    phases = []
    for size, count in classes:
        rank = 0
        while rank < count:
            turn = sorted(range(k), key=lambda j: (loads[j], j))
            first = turn[0]
            active = [j for j in turn if (loads[j], j) < (loads[first] + size, first)]
            left = count - rank
            if len(active) < k:
                last, joins = active[-1], turn[len(active)]
                gap = loads[joins] - loads[last]
                cycles = gap // size + (1 if gap % size or last < joins else 0)
            else:
                cycles = left // k + 1
            take = min(left, cycles * len(active))
            phases.append((size, rank, rank + take, active))
            for pos, j in enumerate(active):
                loads[j] += size * (take // len(active) + (1 if pos < take % len(active) else 0))
            rank += take
    return phases


def _assign_groups(groups: DataFrame, order: list[Column], k: int, name: str) -> DataFrame:
    """Fold of every group (``_key``, ``_n``): largest first into the lightest fold.

    Only the histogram of group sizes travels to the driver. N rows have fewer than sqrt(2 N) distinct
    group sizes, so that list is small even for a trillion rows. Ranks within a size come from a sort.
    """
    hist = [(r["_n"], r["m"]) for r in groups.groupBy("_n").agg(F.count(F.lit(1)).alias("m")).collect()]
    hist.sort(reverse=True)
    starts, at = {}, 0
    for size, m in hist:
        starts[size] = at
        at += m
    plan: dict[int, list] = {}
    for size, lo, hi, turn in lightest_first_schedule(hist, k):
        plan.setdefault(size, []).append((starts[size] + lo, starts[size] + hi, turn))
    table = groups.sparkSession.createDataFrame(
        [(s, p) for s, p in plan.items()], "_size bigint, _plan array<struct<lo:bigint,hi:bigint,turn:array<int>>>"
    )
    placed = global_index(groups, [F.desc("_n"), *order], "_rank")
    joined = placed.join(broadcast_if_small(table), F.col("_n") == F.col("_size"))
    phase = F.filter("_plan", lambda p: (p["lo"] <= F.col("_rank")) & (F.col("_rank") < p["hi"]))[0]
    joined = joined.withColumn("_phase", phase)
    turn = F.col("_phase.turn")
    pick = F.get(turn, F.pmod(F.col("_rank") - F.col("_phase.lo"), F.size(turn)).cast("int"))
    return joined.select("_key", "_n", (pick + 1).cast("int").alias(name))


def _spread(df: DataFrame, key: Column, groups: DataFrame, name: str) -> DataFrame:
    return join_counted(df.withColumn("_key", key), groups, ["_key"], {name: name}, "_n").drop("_key")


def group_folds(df: DataFrame, group_col: str, k: int, *, name: str = "fold") -> DataFrame:
    """No group in two folds. Ties between equal sizes go by group name, descending."""
    require_columns(df, group_col, label="group_column")
    if k < 2:
        raise ValueError("n_splits must be at least 2")
    key = F.coalesce(F.col(group_col).cast("string"), F.lit("nan"))
    sizes = df.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    found = sizes.limit(k).count()
    if found < k:
        raise ValueError(f"group split requires at least {k} unique groups, found {found}")
    return _spread(df, key, _assign_groups(sizes, [F.desc("_key")], k, name), name)


def derived_group_folds(df: DataFrame, key: Column | str, k: int, *, order_col: str, name: str = "fold") -> DataFrame:
    """Group folds over a computed key (null counts as ""); ties go by first appearance in ``order_col``.

    With fewer groups than folds the unused folds do not exist; fewer than two folds is an error.
    """
    require_columns(df, order_col)
    _check_size(df.count(), k)
    key = F.coalesce((F.expr(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    sizes = df.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("_n"), F.min(order_col).alias("_first"))
    if sizes.limit(2).count() < 2:
        raise ValueError("the derived key gives fewer than 2 non-empty folds; reduce n_splits")
    return _spread(df, key, _assign_groups(sizes, [F.col("_first"), F.col("_key")], k, name), name)


def time_splits(df: DataFrame, time_col: str, id_col: str, k: int, *, ascending: bool = True) -> DataFrame:
    """Expanding windows: ``split, role, <id>``. Each test window has ``n // (k + 1)`` rows, and everything
    before it is its training side."""
    require_columns(df, time_col, label="time_column")
    n = df.count()
    _check_size(n, k)
    size = n // (k + 1)
    if size == 0:
        raise ValueError(f"too few rows ({n}) for {k} time splits")
    first = n - k * size
    window = _timed_pieces(df.select(id_col, time_col), time_col, id_col, ascending, [first + j * size for j in range(k)], "_w")
    laid = window.select(id_col, "_w", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("split"))
    role = F.when(F.col("_w") < F.col("split"), F.lit("train")).when(F.col("_w") == F.col("split"), F.lit("test"))
    return laid.select("split", role.alias("role"), id_col).filter(F.col("role").isNotNull())


def assign_folds(df: DataFrame, id_col: str, cfg: SplitConfig, k: int, *, name: str = "fold") -> DataFrame:
    """Fold column by configuration (all methods but the overlapping time windows)."""
    if cfg.method == "random":
        return random_folds(df, id_col, k, seed=cfg.random_state, shuffle=cfg.shuffle, name=name)
    if cfg.method == "group":
        if not cfg.group_column:
            raise ValueError("group_column must be provided for group split")
        return group_folds(df, cfg.group_column, k, name=name)
    if cfg.method == "scaffold":
        if not cfg.derived_key:
            raise ValueError("derived_key must be provided for a derived-key split")
        return derived_group_folds(df, cfg.derived_key, k, order_col=id_col, name=name)
    if cfg.method == "time_series":
        if not cfg.time_column:
            raise ValueError("time_column must be provided for time_series split")
        require_columns(df, cfg.time_column, label="time_column")
        return _time_fold_column(df, id_col, cfg, k, name)
    raise ValueError(f"unknown split method: {cfg.method}")


def _time_fold_column(df: DataFrame, id_col: str, cfg: SplitConfig, k: int, name: str) -> DataFrame:
    """Time windows as one number per row: 0 is the warm-up, window s is tested after training on all
    smaller numbers."""
    n = df.count()
    _check_size(n, k)
    size = n // (k + 1)
    if size == 0:
        raise ValueError(f"too few rows ({n}) for {k} time splits")
    first = n - k * size
    return _timed_pieces(df, cfg.time_column, id_col, cfg.time_ascending, [first + j * size for j in range(k)], name)


def train_test(df: DataFrame, cfg: SplitConfig, fold: int, *, name: str = "fold") -> tuple[DataFrame, DataFrame]:
    train = F.col(name) < fold if cfg.method == "time_series" else F.col(name) != fold
    return df.filter(train), df.filter(F.col(name) == fold)


def holdout(df: DataFrame, id_col: str, cfg: SplitConfig, fraction: float, *, name: str = "is_valid") -> DataFrame:
    """One validation flag per row. Random: ``ceil(n f)`` rows; time: the tail; otherwise fold 1 of ``min(5, n)``."""
    n = df.count()
    if n < 4:
        raise ValueError("need at least 4 rows to hold out a validation set")
    n_valid = min(max(1, math.ceil(n * fraction)), n - 1)
    if cfg.method == "random":
        return _shuffled_pieces(df, id_col, cfg.random_state, [n_valid], name).withColumn(name, F.col(name) == 0)
    if cfg.method == "time_series":
        if not cfg.time_column:
            raise ValueError("time_column must be provided for time_series split")
        return _timed_pieces(df, cfg.time_column, id_col, cfg.time_ascending, [n - n_valid], name).withColumn(name, F.col(name) == 1)
    return assign_folds(df, id_col, cfg, min(5, n), name="_fold").withColumn(name, F.col("_fold") == 1).drop("_fold")
