"""Cut keys, preferences by kind, scoring gaps, parameter limits, search modes and broadcast limits."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from propspark.operators import folds as S
from propspark.operators.dedup import deduplicate, prefer_rows
from propspark.operators.domain import pca_blocks, stacked
from propspark.operators.metrics import _kendall_exact_p, metric_table
from propspark.operators.ordered import cut_keys
from propspark.operators.resample import counted_draws
from propspark.operators.similarity import Block
from propspark.plans import models as M
from propspark.plans import search as H
from propspark.plans.features import Feature
from propspark.session import broadcast_if_small


@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_cut_keys(spark, limit):
    rng = np.random.default_rng(limit)
    values = [(int(v), i) for i, v in enumerate(np.concatenate([rng.integers(-(10**12), 10**12, 200), np.repeat(7, 40), rng.integers(0, 9, 60)]))]
    df = spark.createDataFrame(values, "v long, id long").repartition(3)
    ranks = [0, 1, 99, 150, 151, 200, 299]
    got = cut_keys(df, F.col("v"), [F.col("v"), F.col("id")], ranks, accuracy=50, limit=limit)
    assert got == [sorted(values)[r] for r in ranks]


def test_folds_do_not_move_rows(spark):
    df = spark.range(1000).withColumn("wide", F.repeat(F.lit("x"), 100)).withColumn("ts", F.timestamp_seconds(F.col("id") % 50))
    cfg = S.SplitConfig("time_series", time_column="ts")
    for out in (S.random_folds(df, "id", 7), S.random_folds(df, "id", 7, shuffle=False), S.holdout(df, "id", S.SplitConfig("random"), 0.1),
                S.holdout(df, "id", cfg, 0.1), S.assign_folds(df, "id", cfg, 4)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort" not in plan and "ExistingRDD" not in plan
        assert out.count() == 1000
    down = S.assign_folds(df, "id", S.SplitConfig("time_series", time_column="ts", time_ascending=False), 4)
    order = sorted(((-(i % 50), i) for i in range(1000)))
    want = {i: max(0, (at - 200) // 200 + 1) for at, (_, i) in enumerate(order)}
    assert {r["id"]: r["fold"] for r in down.collect()} == want


def test_text_preference_never_matches_a_boolean(spark):
    df = spark.createDataFrame([("a", 1.0, "False", False, 0), ("a", 3.0, "True", True, 1), ("b", 5.0, "x", None, 1)], "k string, y double, text string, flag boolean, n int")
    get = lambda col, value, **kw: {r["k"]: (r["y_deduplicated"], r["n_reps"]) for r in deduplicate(
        df, key_cols=["k"], target_col="y", prefer_col=col, prefer_value=value, **kw).collect()}
    assert get("text", "False") == get("text", False) == {"a": (2.0, 2), "b": (5.0, 1)}
    assert get("flag", "False") == get("flag", False) == {"a": (1.0, 1), "b": (5.0, 1)}
    assert get("text", "x") == {"a": (2.0, 2), "b": (5.0, 1)} and get("flag", "x")["a"] == (2.0, 2) and get("n", "x")["a"] == (2.0, 2)
    assert get("n", 1)["a"] == (3.0, 1) and get("n", True)["a"] == (2.0, 2)
    assert prefer_rows(df, key_cols=["k"], prefer_col="text", prefer_value="False").count() == 3


@pytest.mark.parametrize("group_rows", [2, 1000])
def test_median_by_either_way(spark, group_rows):
    rng = np.random.default_rng(0)
    rows = [(int(k), float(y), int(p)) for k, y, p in zip(rng.integers(0, 9, 200), rng.normal(size=200), rng.integers(0, 2, 200))]
    df = spark.createDataFrame(rows, "k long, y double, p long")
    out = deduplicate(df, key_cols=["k"], target_col="y", method="median", prefer_col="p", prefer_value=1, group_rows=group_rows)
    for r in out.collect():
        own = [y for k, y, p in rows if k == r["k"] and p] or [y for k, y, _ in rows if k == r["k"]]
        assert r["y_deduplicated"] == pytest.approx(np.median(own)) and r["n_reps"] == len(own)


def test_gaps_that_training_had_not(spark):
    df = spark.createDataFrame([(float(i), float(i * i), 3.0 * i + 1) for i in range(40)] + [(500.0, 1.0, None)], "a double, b double, y double")
    num = (Feature("num", "numeric", "a", columns=("a", "b")),)
    for model, params in (("linear", {}), ("rf", {"n_estimators": 3, "max_depth": 4})):
        fitted = M.fit_model(df, num, "y", model, params=params)
        assert fitted.medians == {"a": 19.5, "b": (19**2 + 20**2) / 2}  # the row without a target tells nothing
        got = [r["p"] for r in fitted.predict(spark.createDataFrame([(None, 4.0), (2.0, None), (None, None)], "a double, b double"), "p").collect()]
        assert all(math.isfinite(p) for p in got)


def test_parameters_beyond_the_library_are_errors():
    for depth in (31, 40, None, -1):
        with pytest.raises(ValueError, match="max_depth"):
            M.make_estimator("rf", {"max_depth": depth})
    with pytest.raises(ValueError, match="min_child_weight"):
        M.make_estimator("xgb", {"min_child_weight": 0.4})
    assert M.make_estimator("xgb", {"min_instances": 7}).getMinInstancesPerNode() == 7 and M.make_estimator("rf").getMaxDepth() == 30


def test_search_modes():
    drawn = [H.draw_params(H.SPACES["rf"], 1, i) for i in range(300)]
    depth = [d["max_depth"] for d in drawn]
    assert 0.4 < np.mean([d == M.MAX_DEPTH for d in depth]) < 0.62 and min(depth) == 2
    share = [d["max_features"] for d in drawn]
    assert {"sqrt", "log2"} < set(share) and all(isinstance(s, str) or 0.1 <= s <= 1 for s in share) and len(set(share)) > 50
    assert {type(H.draw_params(H.SPACES["svm"], 1, i)["gamma"]) for i in range(40)} == {str, float}
    assert all(H.draw_params(H.SPACES[m], 1, 3) == H.draw_params(H.SPACES[m], 1, 3) for m in H.SPACES)
    for m in H.SPACES:
        for i in range(20):
            M.make_estimator(m, H.draw_params(H.SPACES[m], 2, i))


def test_search_time_limit(spark):
    df = spark.createDataFrame([(float(i % 7), float(i), i % 2 + 1) for i in range(60)], "a double, y double, _inner int")
    num = (Feature("num", "numeric", "a", columns=("a",)),)
    cfg = H.SearchConfig(True, n_trials=5, timeout_s=0.0, space={"n_estimators": ("int", 2, 3, 1), "max_depth": ("int", 2, 3, 1)})
    _, trials = H.tune(df, num, "y", "rf", cfg, split=S.SplitConfig("random"), n_folds=2)
    assert len(trials) == 1


def test_nearly_monotone_p_value():
    assert _kendall_exact_p(4, 0) == pytest.approx(2 / 24) and _kendall_exact_p(4, 1) == pytest.approx(8 / 24)
    assert _kendall_exact_p(10**9, 1) == 0.0


def test_draws_are_counted(spark):
    df = spark.createDataFrame([(g, i, float(i)) for g in "ab" for i in range(30)], "g string, id long, y double")
    out = counted_draws(df, ["g"], "id", ["y"], samples=20)
    per = {(r["g"], r["Sample"]): (r["n"], r["m"]) for r in out.groupBy("g", "Sample").agg(F.sum("_weight").alias("n"), F.count("*").alias("m")).collect()}
    assert len(per) == 40 and all(n == 30 and m < 30 for n, m in per.values())


def test_spread_in_one_pass(spark):
    rng = np.random.default_rng(1)
    rows = [(float(1e6 + a), float(1e6 + b)) for a, b in rng.normal(size=(500, 2))]
    df = spark.createDataFrame(rows, "x double, y double")
    x, y = np.array(rows).T
    got = metric_table(df, "x", "y", metrics=["r2", "rae"]).first()
    assert got["r2"] == pytest.approx(1 - ((x - y) ** 2).sum() / ((x - x.mean()) ** 2).sum()) and got["rae"] == pytest.approx(np.abs(x - y).sum() / np.abs(x - x.mean()).sum())
    weighted = metric_table(df.withColumn("w", F.lit(2)), "x", "y", metrics=["r2"], weight="w").first()
    assert weighted["r2"] == pytest.approx(got["r2"])


def test_broadcast_is_bounded_by_rows_and_bytes(spark):
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    small, wide = spark.range(10), spark.range(2000).withColumn("t", F.repeat(F.lit("x"), 1000))
    assert hinted(broadcast_if_small(small)) and hinted(broadcast_if_small(small, max_estimate=0))
    assert not hinted(broadcast_if_small(small, max_rows=5, max_estimate=0))
    assert not hinted(broadcast_if_small(wide, max_bytes=1 << 20, max_estimate=0)) and hinted(broadcast_if_small(wide, max_bytes=4 << 20, max_estimate=0))


def test_pca_over_stacked_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [int(b) for b in np.flatnonzero(rng.random(6) < 0.5)], [float(x) for x in rng.normal(size=3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, bits array<int>, e array<double>")
    blocks = [Block("b", "bits", "binary", 6), Block("e", "e", "dense", 3)]
    full = np.array([[float(j in bits) for j in range(6)] + e for _, bits, e in rows])
    assert np.allclose(np.array([r["stacked"] for r in stacked(df, blocks).orderBy("id").collect()]), full)
    got = pca_blocks(df.filter("id < 30"), df.filter("id >= 30"), blocks).orderBy("id").collect()
    centred = full - full.mean(axis=0)
    _, values, axes = np.linalg.svd(centred, full_matrices=False)
    assert [r["role"] for r in got] == ["train"] * 30 + ["test"] * 10
    assert np.allclose(np.abs([[r["pc1"], r["pc2"]] for r in got]), np.abs(centred @ axes[:2].T))
