"""Bootstrap resampling: every row is also a draw slot, and a hash says which row it draws.

Groups that fit a task are resampled there: their rows are sent to a task for every few resamples, draws and
metrics never leave it. Larger groups draw by a join, or, where the sums of errors are all that is asked for, by
splitting: a block of rows finds out by itself how many draws of each resample fall into it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propspark.functions.text import hash60, md5
from propspark.operators.metrics import metric_table, rank_sums
from propspark.operators.ordered import GROUP_ROWS_PER_TASK, global_index
from propspark.session import broadcast_if_small, cut_lineage
from propspark.sources.tables import is_empty

# Report names of the evaluation metrics.
REPORT_METRICS = {"MAE": "mae", "RAE": "rae", "R2": "r2", "Spearman R": "spearman_rho", "Kendall's Tau": "kendall_tau"}
# Resamples that one task makes of a group, rows of a block that is split off, and rows of neighbouring blocks that are drawn together.
SAMPLES_PER_TASK, BLOCK_ROWS, RUN_ROWS = 25, 100_000, 512
# Cumulative Poisson(1) probabilities for weights 0, 1, 2, ...
_POISSON_CDF = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
                0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


def position_in_group(df: DataFrame, by: Iterable[str], key: str) -> DataFrame:
    """Add ``_pos`` (0-based, in key order within the group) and ``_size``."""
    by = list(by)
    at = global_index(df, [*by, key], "_g")
    span = at.groupBy(*by).agg(F.min("_g").alias("_start"), F.count(F.lit(1)).alias("_size"))
    return at.join(broadcast_if_small(span), by).withColumn("_pos", F.col("_g") - F.col("_start")).drop("_g", "_start")


def counted_draws(df: DataFrame, by: Iterable[str], key: str, cols: Iterable[str], *, samples: int, seed: int = 0) -> DataFrame:
    """``samples`` resamples of full size with replacement, per group: ``by, Sample, cols, _weight``.

    Draws of the same row are counted before the rows are joined, so a resample has each row once.
    """
    by, cols = list(by), list(cols)
    rows = cut_lineage(position_in_group(df.select(*by, key, *cols), by, key))
    slot = rows.select(*by, "_pos", "_size", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("Sample"))
    drawn = F.pmod(hash60(F.concat_ws(":", F.lit(str(seed)), F.col("Sample"), F.col("_pos"))), F.col("_size"))
    slot = slot.groupBy(*by, "Sample", drawn.alias("_pos")).agg(F.count(F.lit(1)).alias("_weight"))
    return slot.join(broadcast_if_small(rows.select(*by, "_pos", *cols)), [*by, "_pos"]).select(*by, "Sample", *cols, "_weight")


def bootstrap_draws(df: DataFrame, by: Iterable[str], key: str, cols: Iterable[str], *, samples: int, seed: int = 0) -> DataFrame:
    """The same resamples with a row for every draw: ``by, Sample, cols``."""
    by, cols = list(by), list(cols)
    counted = counted_draws(df, by, key, cols, samples=samples, seed=seed)
    return counted.select(*by, "Sample", *cols, F.explode(F.sequence(F.lit(1), F.col("_weight").cast("int"))).alias("_nth")).drop("_nth")


def poisson_draws(df: DataFrame, key: str, cols: Iterable[str], *, samples: int, seed: int = 0) -> DataFrame:
    """Approximate bootstrap for very large tables: independent Poisson(1) row weights, no join."""
    u = hash60(F.concat_ws(":", F.lit(str(seed)), F.col("Sample"), F.col(key))) / F.lit(float(1 << 60))
    weight = sum(((u >= c).cast("int") for c in _POISSON_CDF), F.lit(0))
    spread = df.select(key, *cols, F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("Sample"))
    return spread.withColumn("_weight", weight).filter("_weight > 0").drop(key)


def weighted_metrics(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[float | None]:
    """The five report metrics of weighted rows (truth, prediction) by the rules of ``metric_table``; undefined ones are None."""
    n, err = w.sum(), x - y
    mae, dev = (w * np.abs(err)).sum() / n, x - (w * x).sum() / n
    sad, sst = (w * np.abs(dev)).sum(), (w * dev * dev).sum()
    sums = rank_sums(x, y, w)
    s, pairs, tie_x, tie_y = float(sums[0]), n * (n - 1) / 2, float(sums[2]), float(sums[3])
    sxy, sxx, syy = sums[-3:]
    clip = lambda v: min(1.0, max(-1.0, v))
    return [
        mae, mae * n / sad if sad else None, 1 - (w * err * err).sum() / sst if sst else None,
        clip(sxy / (np.sqrt(sxx) * np.sqrt(syy))) if sxx > 0 and syy > 0 else None,
        clip(s / (np.sqrt(pairs - tie_x) * np.sqrt(pairs - tie_y))) if pairs > tie_x and pairs > tie_y else None]


def _slot_weights(seed: int, sample: int, keys: list) -> np.ndarray:
    """How often the slots of a resample draw each row of a group, in the order of its keys, as ``counted_draws`` does."""
    start, n = md5(f"{seed}:{sample}:".encode()), len(keys)
    drawn = np.empty(n, np.int64)
    for pos in range(n):
        h = start.copy()
        h.update(b"%d" % pos)
        drawn[pos] = int(h.hexdigest()[:15], 16) % n
    return np.bincount(drawn, minlength=n)


def _poisson_weights(seed: int, sample: int, keys: list) -> np.ndarray:
    """The weights of ``poisson_draws``; a key is the text that follows seed and resample there."""
    start = f"{seed}:{sample}"
    found = np.array([int(md5((start + key).encode()).hexdigest()[:15], 16) for key in keys], np.int64)
    return np.searchsorted(_POISSON_CDF, found.astype(float) / float(1 << 60), "right")


def _resampled(rows: DataFrame, by: list[str], key: str, samples: int, seed: int, weights=_slot_weights) -> DataFrame:
    """Metrics of each resample of groups that fit a task: ``by, Sample`` and a column for each metric.

    The draws are those of ``counted_draws`` or ``poisson_draws``. A row is sent once for every ``SAMPLES_PER_TASK`` resamples.
    """
    names = list(REPORT_METRICS.values())
    fields = [rows.schema[k] for k in by]
    out = T.StructType([*fields, T.StructField("Sample", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in names]])

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, na_position="first", kind="stable")
        x, y, held_keys = pdf["_x"].to_numpy(float), pdf["_y"].to_numpy(float), pdf[key].to_list()
        first, found = group[-1] * SAMPLES_PER_TASK, []
        for sample in range(first, min(first + SAMPLES_PER_TASK, samples)):
            w = weights(seed, sample, held_keys)
            held = w > 0
            if held.any():
                found.append([*group[:-1], sample, *weighted_metrics(x[held], y[held], w[held].astype(float))])
        return pd.DataFrame(found, columns=out.names)

    every = F.explode(F.sequence(F.lit(0), F.lit((samples - 1) // SAMPLES_PER_TASK)))
    return rows.withColumn("_task", every).groupBy(*by, "_task").applyInPandas(run, out)


def _stream(*name: object) -> np.random.Generator:
    """Random numbers that depend on a name alone."""
    return np.random.Generator(np.random.Philox(key=int(md5(":".join(map(str, name)).encode()).hexdigest(), 16)))


def block_totals(name: tuple, size: int, block: int, block_rows: int, samples: int) -> np.ndarray:
    """How many of the ``size`` draws of each resample fall into a block of the positions.

    The range of all blocks is halved down to the block; the draws of the left half are binomial, with
    numbers that belong to the half and not to who asks. So all blocks agree, and their totals add up to ``size``.
    """
    return run_totals(name, size, range(block, block + 1), block_rows, samples)[block]


def run_totals(name: tuple, size: int, blocks: range, block_rows: int, samples: int) -> dict[int, np.ndarray]:
    """``block_totals`` of neighbouring blocks; a half that they share is drawn once."""
    found, open_ = {}, [(np.full(samples, size, np.int64), 0, -(-size // block_rows))]
    while open_:
        total, lo, hi = open_.pop()
        if hi - lo == 1:
            found[lo] = total
            continue
        mid = (lo + hi) // 2
        left, rows = (mid - lo) * block_rows, min(size, hi * block_rows) - lo * block_rows
        drawn = _stream(*name, "split", lo, hi).binomial(total, left / rows)
        open_ += [part for part in ((drawn, lo, mid), (total - drawn, mid, hi)) if part[1] < blocks.stop and part[2] > blocks.start]
    return found


def _run_weights(name: tuple, pdf: pd.DataFrame, block_rows: int, samples: int, wanted: range) -> Iterator[tuple[slice, int, np.ndarray]]:
    """For the rows of a run (in order of ``_pos``): the slice of a block, a wanted resample and the weights there."""
    size, held = int(pdf["_size"].iloc[0]), pdf["_block"].to_numpy()
    totals = run_totals(name, size, range(int(held[0]), int(held[-1]) + 1), block_rows, samples)
    for block in np.unique(held).tolist():
        at, rows = int(np.searchsorted(held, block)), min(size, (block + 1) * block_rows) - block * block_rows
        for sample in wanted:
            draws = _stream(*name, "block", block, sample).integers(0, rows, totals[block][sample])
            yield slice(at, at + rows), sample, np.bincount(draws, minlength=rows)


def _blocks(df: DataFrame, by: list[str], key: str, cols: list[str], block_rows: int) -> DataFrame:
    """Rows with their block and its run, ``RUN_ROWS`` rows of neighbouring blocks (one block, if that is larger)."""
    rows = position_in_group(df.select(*by, key, *cols), by, key).withColumn("_block", F.expr(f"_pos div {block_rows}"))
    return cut_lineage(rows.withColumn("_run", F.expr(f"_block div {max(1, RUN_ROWS // block_rows)}")))


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by key in a stated number of tasks: they are few bytes for much work, and would be merged by their size."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def split_weights(df: DataFrame, by: Iterable[str], key: str, cols: Iterable[str] = (), *, samples: int, seed: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact multinomial resamples by splitting: ``by, Sample, <key>, cols, _weight`` (weights above 0, ``n`` in all for each group of n).

    The same draws as those of ``split_metrics``; they follow from seed, group and the order of the keys alone.
    """
    by, cols = list(by), list(cols)
    blocks = _blocks(df, by, key, cols, block_rows)
    out = T.StructType([*[blocks.schema[c] for c in (*by, key, *cols)], T.StructField("Sample", T.IntegerType()), T.StructField("_weight", T.LongType())])

    # A task's rows times resamples stay below those of a whole block.
    per_task = max(SAMPLES_PER_TASK, SAMPLES_PER_TASK * BLOCK_ROWS // max(RUN_ROWS, block_rows))

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        wanted = range(group[-1] * per_task, min((group[-1] + 1) * per_task, samples))
        rows, drawn, weights = [], [], []
        for at, sample, w in _run_weights((seed, *group[:-2]), pdf, block_rows, samples, wanted):
            held = np.flatnonzero(w)
            rows.append(at.start + held)
            drawn.append(np.full(len(held), sample, np.int32))
            weights.append(w[held])
        part = pdf.iloc[np.concatenate(rows)][[*by, key, *cols]]
        return part.assign(Sample=np.concatenate(drawn), _weight=np.concatenate(weights))

    every = F.explode(F.sequence(F.lit(0), F.lit((samples - 1) // per_task)))
    return _dealt(blocks.withColumn("_task", every), *by, "_run", "_task").groupBy(*by, "_run", "_task").applyInPandas(run, out)


def split_metrics(df: DataFrame, y: str, p: str, *, by: Iterable[str], key: str, samples: int = 1000, seed: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Metrics that are sums of errors, for groups of any size: ``by, Sample, n, mae, rae, r2``.

    A run of blocks sends its sums for each resample, never a draw: rows are moved once, and ``samples`` partial sums for
    each ``block_rows`` (or ``RUN_ROWS``) rows. A second pass makes the same draws again for deviations from each resample's mean.
    """
    by = list(by)
    rows = df.select(*by, key, F.col(y).cast("double").alias("_x"), F.col(p).cast("double").alias("_y")).dropna(subset=["_x", "_y"])
    blocks = _blocks(rows, by, key, ["_x", "_y"], block_rows)
    fields = [blocks.schema[c] for c in by]

    def passing(names: list[str], sums) -> tuple:
        shape = T.StructType([*fields, T.StructField("Sample", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in names]])

        def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_pos")
            x, e = pdf["_x"].to_numpy(), (pdf["_x"] - pdf["_y"]).to_numpy()
            means = pdf["_means"].iloc[0] if "_means" in pdf else np.zeros(samples)
            found = np.zeros((samples, len(names)))
            for at, s, w in _run_weights((seed, *group[:-1]), pdf, block_rows, samples, range(samples)):
                found[s] += sums(w, x[at], e[at], means[s])
            return pd.DataFrame([[*group[:-1], s, *row] for s, row in enumerate(found.tolist())], columns=shape.names)

        return run, shape

    run, shape = passing(["_n", "_sx", "_sae", "_sse"], lambda w, x, e, _: (w.sum(), w @ x, w @ np.abs(e), w @ (e * e)))
    first = _dealt(blocks, *by, "_run").groupBy(*by, "_run").applyInPandas(run, shape)
    first = cut_lineage(first.groupBy(*by, "Sample").agg(*[F.sum(c).alias(c) for c in shape.names[-4:]]))
    means = first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("Sample", (F.col("_sx") / F.col("_n")).alias("m")))), lambda v: v["m"]).alias("_means"))
    run, shape = passing(["_sad", "_sst"], lambda w, x, e, mean: (w @ np.abs(x - mean), w @ (x - mean) ** 2))
    second = _dealt(blocks, *by, "_run").join(broadcast_if_small(means), by).groupBy(*by, "_run").applyInPandas(run, shape)
    second = second.groupBy(*by, "Sample").agg(F.sum("_sad").alias("_sad"), F.sum("_sst").alias("_sst"))
    both = first.join(second, [*by, "Sample"])
    return both.select(
        *by, "Sample", F.col("_n").cast("bigint").alias("n"), (F.col("_sae") / F.col("_n")).alias("mae"),
        F.try_divide("_sae", "_sad").alias("rae"), (1 - F.try_divide("_sse", "_sst")).alias("r2"))


def bootstrap_metrics(
    df: DataFrame, y: str, p: str, *, by: Iterable[str], key: str, samples: int = 1000, seed: int = 0, method: str = "exact",
    group_rows: int = GROUP_ROWS_PER_TASK
) -> DataFrame:
    """Long table ``by, Sample, Metric, Value`` of the five report metrics.

    "exact" draws by hash, groups up to ``group_rows`` rows inside tasks and larger ones by a join; "poisson" is
    approximate, with such groups inside tasks too; "split" gives the error metrics alone (MAE, RAE, R2), for groups of any size, without moving draws.
    Rows with a missing truth or prediction are left out. The group columns must not be null.
    """
    by = list(by)
    report = dict(REPORT_METRICS)
    if method == "exact":
        wide = _exact_metrics(df.dropna(subset=[y, p]), y, p, by, key, samples, seed, group_rows)
    elif method == "poisson":
        wide = _poisson_metrics(df, y, p, by, key, samples, seed, group_rows)
    elif method == "split":
        wide = split_metrics(df, y, p, by=by, key=key, samples=samples, seed=seed)
        report = {n: c for n, c in report.items() if c in wide.columns}
    else:
        raise ValueError(f"unknown bootstrap method: {method}")
    pairs = F.array(*[F.struct(F.lit(n).alias("Metric"), F.col(c).alias("Value")) for n, c in report.items()])
    return wide.select(*by, "Sample", F.inline(pairs))


def _metrics_of_draws(draws: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    return metric_table(draws, y, p, metrics=list(REPORT_METRICS.values()), by=[*by, "Sample"], weight="_weight", undefined_as_zero=False)


def _exact_metrics(df: DataFrame, y: str, p: str, by: list[str], key: str, samples: int, seed: int, group_rows: int) -> DataFrame:
    rows = df.select(*by, key, y, p)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    large = cut_lineage(sizes.filter(F.col("_rows") > group_rows))
    in_task = lambda part: _resampled(
        part.select(*by, key, F.col(y).cast("double").alias("_x"), F.col(p).cast("double").alias("_y")), by, key, samples, seed)
    if is_empty(large):
        return in_task(rows)
    side = broadcast_if_small(large.select(*by))
    drawn = counted_draws(rows.join(side, by, "left_semi"), by, key, [y, p], samples=samples, seed=seed)
    names = list(REPORT_METRICS.values())
    return in_task(rows.join(side, by, "left_anti")).unionByName(_metrics_of_draws(drawn, y, p, by).select(*by, "Sample", *names))


def _poisson_metrics(df: DataFrame, y: str, p: str, by: list[str], key: str, samples: int, seed: int, group_rows: int) -> DataFrame:
    """Groups up to ``group_rows`` rows are weighted inside tasks, larger ones and those that hold NaN row by row."""
    x_y = F.col(y).cast("double").alias("_x"), F.col(p).cast("double").alias("_y")
    after = F.coalesce(F.concat(F.lit(":"), F.col(key).cast("string")), F.lit(""))
    rows = df.select(*by, key, y, p, after.alias("_after"), *x_y).filter(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), F.max(F.isnan("_x") | F.isnan("_y")).alias("_nan"))
    large = cut_lineage(sizes.filter((F.col("_rows") > group_rows) | F.col("_nan")))
    in_task = lambda part: _resampled(part.select(*by, "_after", "_x", "_y"), by, "_after", samples, seed, _poisson_weights)
    if is_empty(large):
        return in_task(rows)
    side = broadcast_if_small(large.select(*[F.col(k).alias(f"_l_{k}") for k in by]))
    on = [rows[k].eqNullSafe(side[f"_l_{k}"]) for k in by]
    drawn = poisson_draws(rows.join(side, on, "left_semi"), key, [*by, y, p], samples=samples, seed=seed)
    names = list(REPORT_METRICS.values())
    return in_task(rows.join(side, on, "left_anti")).unionByName(_metrics_of_draws(drawn, y, p, by).select(*by, "Sample", *names))
