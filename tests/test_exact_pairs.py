"""Pair counts beyond 2^53 against whole numbers of Python."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from propspark.operators import metrics as M


def pairs(x, y, w):
    """Net order, and pairs not tied in x and in y, of weighted rows."""
    s = sum((int(x[i] > x[j]) - int(x[i] < x[j])) * (int(y[i] > y[j]) - int(y[i] < y[j])) * w[i] * w[j] for i, j in combinations(range(len(x)), 2))
    free = lambda v: sum(w[i] * w[j] for i, j in combinations(range(len(v)), 2) if v[i] != v[j])
    return s, free(x), free(y)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 25, (2, 90))
    return x.tolist(), y.tolist(), [int(v) for v in rng.integers(1 << 38, 1 << 40, 90)]


def test_products_in_limbs():
    rng = np.random.default_rng(2)
    a, b = rng.integers(-(1 << 62), 1 << 62, (2, 500))
    assert M.whole_dot(a, b) == sum(int(p) * int(q) for p, q in zip(a, b))
    assert M.whole_dot(a[:0], b[:0]) == 0 and M.whole_dot(a // (1 << 50), b // (1 << 50)) == sum((int(p) >> 50) * (int(q) >> 50) for p, q in zip(a, b))


def test_net_order(rows):
    x, y, w = (np.array(v) for v in rows)
    s, free_x, _ = pairs(*rows)
    assert abs(s) > 1 << 70 or free_x > 1 << 70
    assert M.net_order(x, y, w.astype(float)) == s
    cells = {}
    for p, q, n in zip(*rows):
        cells[p, q] = cells.get((p, q), 0) + n
    i, j = np.array(list(cells)).T
    assert M.net_order_cells(i, j, np.array(list(cells.values()), float)) == s


@pytest.mark.parametrize("leaf", [1_000_000, 20])
def test_tau_of_many_rows(spark, rows, leaf, monkeypatch):
    """Inside a task and through the buckets: the last digits of tau are those of the whole numbers."""
    df = spark.createDataFrame(list(zip(*rows)), "x long, y long, w long")
    s, free_x, free_y = pairs(*rows)
    got = M.metric_table(df, "x", "y", metrics=["kendall_tau", "kendall_tau_pvalue"], weight="w", leaf=leaf).first()
    assert got["kendall_tau"] == pytest.approx(s / math.sqrt(free_x * free_y), rel=1e-14)
    whole = M._net(df.select(F.lit(0).alias("_all"), F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y"), F.col("w").cast("double").alias("_w"))
                   .groupBy("_all", "_x", "_y").agg(F.sum("_w").alias("_w")), ["_all"], leaf, True).first()["s"]
    assert int(whole) == s


def test_weights_that_are_not_whole(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.5), (2.0, 3.0, 1.5), (3.0, 2.0, 0.25)], "x double, y double, w double")
    assert M.metric_table(df, "x", "y", metrics=["kendall_tau"], weight="w").first()["kendall_tau"] is not None
    assert M.net_order(np.array([1.0, 2, 3]), np.array([1.0, 3, 2]), np.array([0.5, 1.5, 0.25])) == pytest.approx(0.5 * 1.5 + 0.5 * 0.25 - 1.5 * 0.25)
