"""Support-vector regression on given features: the epsilon-insensitive loss by Newton steps over distributed sums.

The loss is zero inside the tube, linear outside, and rounded by a parabola of width ``delta`` between; the width
shrinks from step to step until it does not matter. Every step sums gradient and curvature in the tasks, so
what travels has the size of the features and not of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propspark.session import cut_lineage

#: Numbers of the summed matrix that travel together.
PIECE = 1 << 14


def tube_loss(r: np.ndarray, epsilon: float, delta: float) -> np.ndarray:
    """Rounded epsilon-insensitive loss of residuals; at most ``delta`` / 2 below the exact one."""
    out = np.maximum(np.abs(r) - epsilon, 0)
    return np.where(out < delta, out * out / (2 * delta), out - delta / 2)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features with a column of ones, and labels, at most 16 MB at a time."""
    for part in batches:
        if len(part):
            step = max(1, (1 << 21) // (len(part["z"].iloc[0]) + 1))
            for at in range(0, len(part), step):
                z = np.stack(part["z"].iloc[at : at + step].to_list())
                yield np.column_stack([z, np.ones(len(z))]), part["y"].iloc[at : at + step].to_numpy(float)


def _sums(rows: DataFrame, w: np.ndarray, epsilon: float, delta: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and curvature of the loss at ``w``, summed over all rows in one pass."""
    m = len(w)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loss, pull, curve = 0.0, np.zeros(m), np.zeros((m, m))
        for z, y in _blocks(batches):
            r = y - z @ w
            over = np.abs(r) - epsilon
            bent = z[(over > 0) & (over < delta)]
            loss += tube_loss(r, epsilon, delta).sum()
            pull -= z.T @ (np.sign(r) * np.clip(over / delta, 0, 1))
            curve += bent.T @ bent / delta
        total = np.concatenate([[loss], pull, curve.ravel()])
        yield pd.DataFrame({"i": np.arange(0, len(total), PIECE), "v": [total[i : i + PIECE] for i in range(0, len(total), PIECE)]})

    # Pieces are added up by place, in as many tasks as there are pieces.
    def add(i: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [i[0]], "v": [np.sum(np.stack(part["v"].to_list()), axis=0)]})

    shape = "i int, v array<double>"
    found = rows.mapInPandas(run, shape).groupBy("i").applyInPandas(add, shape).collect()
    total = np.concatenate([r["v"] for r in sorted(found, key=lambda r: r["i"])])
    return float(total[0]), total[1 : m + 1], total[m + 1 :].reshape(m, m)


@dataclass
class SupportLine:
    """Weights of the features and an intercept."""

    weights: list[float]
    intercept: float

    def transform(self, df: DataFrame) -> DataFrame:
        w, b = np.array(self.weights), self.intercept

        @F.pandas_udf("double")
        def line(v: pd.Series) -> pd.Series:
            step = max(1, (1 << 21) // max(1, len(w)))
            parts = [np.stack(v.iloc[i : i + step].to_list()) @ w + b for i in range(0, len(v), step)]
            return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

        return df.withColumn("_prediction", line(vector_to_array("_features")))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.weights, self.intercept)], "weights array<double>, intercept double").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(path: str) -> SupportLine:
        row = SparkSession.active().read.parquet(path).first()
        return SupportLine(list(row["weights"]), row["intercept"])


def fit_support(df: DataFrame, *, c: float, epsilon: float, tolerance: float = 1e-4, max_passes: int = 100) -> SupportLine:
    """Weights w and intercept b with least |w|^2 / 2 + c * sum(max(0, |y - w z - b| - epsilon)) over ``_features`` and ``_label``.

    The rounding shrinks tenfold, from the spread of the labels to ``tolerance`` of it; each width takes Newton steps
    until the loss falls by less than that share. A step that does not lower the loss is cut to a quarter. No rows
    are an error.
    """
    rows = cut_lineage(df.select(vector_to_array("_features").alias("z"), F.col("_label").cast("double").alias("y")))
    facts = rows.agg(F.count(F.lit(1)), F.max(F.size("z")), F.percentile_approx("y", 0.5), F.stddev_pop("y")).first()
    if not facts[0]:
        raise ValueError("no rows to fit")
    w = np.zeros(facts[1] + 1)
    w[-1] = facts[2]
    ridge = np.append(np.ones(facts[1]), 1e-10)
    delta = scale = max(float(facts[3]), 1e-12)

    def at(v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        loss, pull, curve = _sums(rows, v, epsilon, delta)
        return float(v[:-1] @ v[:-1]) / 2 + c * loss, ridge * v + c * pull, np.diag(ridge) + c * curve

    passes = 0
    while True:
        now, slope, curve = at(w)
        passes += 1
        while passes < max_passes:
            step, size = np.linalg.solve(curve, slope), 1.0
            while passes < max_passes:
                passes += 1
                there = at(w - size * step)
                if there[0] <= now or size < 1e-3:
                    break
                size /= 4
            fallen = now - there[0]
            if fallen > 0:
                w, (now, slope, curve) = w - size * step, there
            if fallen <= tolerance * max(abs(now), 1e-12):
                break
        if delta <= tolerance * scale or passes >= max_passes:
            return SupportLine(w[:-1].tolist(), float(w[-1]))
        delta = max(delta / 10, tolerance * scale)
