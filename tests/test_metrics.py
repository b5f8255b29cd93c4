import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from propspark.operators.metrics import _kendall_exact_p, incomplete_beta, metric_table, net_order, net_order_cells, net_orders
from propspark.operators.resample import bootstrap_draws


def score(spark, y, p, **kw):
    df = spark.createDataFrame(list(zip(map(float, y), map(float, p))), "y double, p double")
    return metric_table(df, "y", "p", **kw).first()


def brute(x, y, w):
    return sum(w[i] * w[j] * np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(len(x)) for j in range(i))


def test_perfect(spark):
    r = score(spark, [1, 2, 3], [1, 2, 3])
    assert (r["rmse"], r["mse"], r["mae"], r["r2"]) == (0, 0, 0, 1)


def test_errors(spark):
    r = score(spark, [0, 0], [3, 4])
    assert (r["rmse"], r["mse"], r["mae"]) == (pytest.approx(math.sqrt(12.5)), 12.5, 3.5)


def test_constant_target(spark):
    assert score(spark, [2, 2, 2], [2, 2, 2], metrics=["r2"])["r2"] == 0.0
    assert score(spark, [2, 2, 2], [2, 2, 2], metrics=["r2"], undefined_as_zero=False)["r2"] is None


def test_ranks(spark):
    up = score(spark, [1, 2, 3, 4], [10, 20, 30, 40])
    assert up["kendall_tau"] == pytest.approx(1) and up["spearman_rho"] == pytest.approx(1)
    assert 0 <= up["kendall_tau_pvalue"] <= 1 and 0 <= up["spearman_pvalue"] <= 1
    assert up["kendall_tau_pvalue"] == pytest.approx(2 / 24)
    down = score(spark, [1, 2, 3, 4], [40, 30, 20, 10])
    assert down["kendall_tau"] == pytest.approx(-1) and down["spearman_rho"] == pytest.approx(-1)
    flat = score(spark, [1, 2, 3, 4], [5, 5, 5, 5])
    assert [flat[c] for c in ("kendall_tau", "spearman_rho", "kendall_tau_pvalue", "spearman_pvalue")] == [0, 0, 1, 1]


def test_unknown_metric(spark):
    with pytest.raises(ValueError, match="unknown metric"):
        score(spark, [1], [1], metrics=["nope"])


def test_net_order_against_brute_force():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 17, 120):
        x, y, w = rng.integers(0, 9, n), rng.integers(0, 7, n), rng.integers(1, 4, n)
        assert net_order(x, y, w) == brute(x, y, w)
    i, j, c = np.array([0, 0, 1, 2]), np.array([0, 2, 1, 0]), np.array([2.0, 1, 3, 1])
    assert net_order_cells(i, j, c) == brute(i, j, c)


def test_large_group_form_is_exact(spark):
    """Buckets of buckets against brute force, with a hot value on one side."""
    rng = np.random.default_rng(5)
    x = np.where(rng.random(900) < 0.35, 0, rng.integers(0, 500, 900)).astype(float)
    y = x + rng.integers(0, 600, 900)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "y double, p double")
    small = metric_table(df, "y", "p", metrics=["kendall_tau", "spearman_rho"]).first()
    large = metric_table(df, "y", "p", metrics=["kendall_tau", "spearman_rho"], leaf=300).first()
    assert large["kendall_tau"] == pytest.approx(small["kendall_tau"], abs=1e-12)
    assert large["spearman_rho"] == pytest.approx(small["spearman_rho"], abs=1e-12)
    pairs = 900 * 899 / 2
    ties = lambda v: sum(c * (c - 1) / 2 for c in np.unique(v, return_counts=True)[1])
    tau = brute(x, y, np.ones(900)) / math.sqrt((pairs - ties(x)) * (pairs - ties(y)))
    assert small["kendall_tau"] == pytest.approx(tau, abs=1e-12)


def test_weights_equal_repetition(spark):
    rows = [(1.0, 2.0, 3), (2.0, 1.0, 1), (4.0, 9.0, 2), (5.0, 3.0, 1)]
    w = metric_table(spark.createDataFrame(rows, "y double, p double, w int"), "y", "p", weight="w").first()
    rep = score(spark, [r[0] for r in rows for _ in range(r[2])], [r[1] for r in rows for _ in range(r[2])])
    for c in ("rmse", "mae", "r2", "rae", "spearman_rho", "kendall_tau", "spearman_pvalue", "kendall_tau_pvalue"):
        assert w[c] == pytest.approx(rep[c])


def test_p_value_helpers():
    # Student t with 2 degrees of freedom has the closed form p = 1 - |t| / sqrt(t^2 + 2).
    r = 0.6
    t = r * math.sqrt(2 / (1 - r * r))
    assert incomplete_beta(1.0, 0.5, 1 - r * r) == pytest.approx(1 - t / math.sqrt(t * t + 2))
    assert _kendall_exact_p(3, 0) == pytest.approx(2 / 6) and _kendall_exact_p(4, 3) == 1.0


def test_bootstrap_draws(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(50)], "id long, v double").withColumn("e", F.lit("a"))
    a = bootstrap_draws(df, ["e"], "id", ["v"], samples=5)
    counts = {r["Sample"]: r["count"] for r in a.groupBy("Sample").count().collect()}
    assert counts == {s: 50 for s in range(5)}
    b = bootstrap_draws(df, ["e"], "id", ["v"], samples=5)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_net_orders_of_many_groups():
    """The sum over groups is that of each group alone; groups may be of one row or of all rows."""
    rng = np.random.default_rng(4)
    for n, groups in ((1, 1), (2, 1), (2, 2), (50, 50), (300, 40), (500, 3), (257, 1)):
        g, x, y, w = rng.integers(0, groups, n), rng.integers(0, 9, n).astype(float), rng.integers(0, 7, n).astype(float), rng.integers(1, 4, n).astype(float)
        each = [brute(x[g == k], y[g == k], w[g == k]) for k in range(groups)]
        assert net_orders(g, x, y, w) == sum(each)
        assert net_orders(g, x, y, w / 3) == pytest.approx(sum(each) / 9, abs=1e-9)
        assert net_orders(g, x, y, w * 2.0**31) == sum(each) * 2**62


def test_small_buckets_are_solved_together(spark, monkeypatch):
    """A group cut into many small buckets takes a few calls of Python, not one for each bucket."""
    import propspark.operators.metrics as M

    rng = np.random.default_rng(5)
    rows = [(float(a), float(b)) for a, b in rng.normal(size=(3000, 2))]
    df = spark.createDataFrame(rows, "y double, p double")
    asked, per_group = [], M._per_group
    monkeypatch.setattr(M, "_per_group", lambda d, keys, *a: asked.append(d.select(*keys).distinct().count()) or per_group(d, keys, *a))
    got = metric_table(df, "y", "p", metrics=["kendall_tau"], leaf=200).first()["kendall_tau"]
    assert got == pytest.approx(metric_table(df, "y", "p", metrics=["kendall_tau"]).first()["kendall_tau"], abs=1e-12)
    assert sum(asked) <= 10
