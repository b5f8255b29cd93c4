"""Medians of many columns at once against numpy, and the plan of the imputation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from propspark.operators import selectors as X


@pytest.mark.parametrize(("bins", "gather"), [(2048, 2048), (16, 3)])
def test_200_columns(spark, bins, gather):
    rng = np.random.default_rng(4)
    n = 301
    m = rng.normal(size=(n, 200)) * 10.0 ** rng.integers(-200, 200, 200)
    m[:, 1], m[:, 2], m[:, 3], m[:, 4] = 7.0, -np.arange(n), np.where(np.arange(n) % 2, 5e-324, -0.0), rng.integers(0, 3, n)
    m[:, 5] = np.where(rng.random(n) < 0.4, np.inf, -np.inf)
    gaps = rng.random(m.shape) < 0.1
    gaps[:, 6], gaps[:, 7] = True, True
    gaps[9, 7] = gaps[1, 8] = False
    rows = [tuple(None if g else float(v) for v, g in zip(r, k)) for r, k in zip(m, gaps)]
    df = spark.createDataFrame(rows, ", ".join(f"`x.{i}` double" for i in range(200))).repartition(5)
    got = {r["feature"]: r["median"] for r in X.column_medians(df, df.columns, bins=bins, gather=gather).collect()}
    assert "x.6" not in got and len(got) == 199
    for i in range(200):
        own = m[~gaps[:, i], i]
        if len(own):
            assert got[f"x.{i}"] == np.median(own) or (i == 5 and np.isnan(got["x.5"]) and np.isnan(np.median(own))), i


def test_imputation_moves_no_rows(spark):
    df = spark.createDataFrame([(1.0, None, None), (3.0, 4.0, None), (None, 8.0, None), (9.0, float("nan"), None)], "a double, b double, c double")
    out = X.median_impute(df, ["a", "b", "c"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan
    assert out.columns == ["a", "b"]
    assert sorted((r["a"], r["b"]) for r in out.select("a", F.nanvl("b", F.lit(-1.0)).alias("b")).collect()) == [(1.0, 6.0), (3.0, 4.0), (3.0, 8.0), (9.0, -1.0)]
    assert X.column_medians(df.limit(0), ["a"]).count() == 0
