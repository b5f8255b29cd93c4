"""Support-vector regression against a slow solver, stacking against normal equations, tuning in one call."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from propspark.operators.folds import SplitConfig
from propspark.plans import models as M
from propspark.plans import search as H
from propspark.plans.features import Feature
from propspark.plans.support import fit_support, tube_loss

NUM = (Feature("num", "numeric", "a", columns=("a", "b")),)


def objective(w, b, z, y, c, epsilon):
    return w @ w / 2 + c * np.maximum(np.abs(y - z @ w - b) - epsilon, 0).sum()


def slow(z, y, c, epsilon, rounds=40_000):
    """Averaged subgradient steps over all rows."""
    w, b, best = np.zeros(z.shape[1]), float(np.median(y)), np.inf
    kept = w, b
    for t in range(1, rounds):
        r = y - z @ w - b
        pull = np.where(np.abs(r) > epsilon, np.sign(r), 0)
        gw, gb = w - c * z.T @ pull, -c * pull.sum()
        size = 0.5 / np.sqrt(t) / max(1e-9, np.sqrt(gw @ gw + gb * gb))
        w, b = w - size * gw, b - size * gb
        if (now := objective(w, b, z, y, c, epsilon)) < best:
            best, kept = now, (w, b)
    return best, kept


@pytest.fixture(scope="module")
def line(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=(200, 3))
    y = z @ [1.0, -2.0, 0.5] + 3 + rng.standard_t(2, 200) * 0.5
    df = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(z, y)], "v array<double>, _label double").repartition(4)
    return z, y, df.select(array_to_vector("v").alias("_features"), "_label")


@pytest.mark.parametrize(("c", "epsilon"), [(10.0, 0.1), (0.05, 0.5)])
def test_agrees_with_a_slow_solver(line, c, epsilon):
    z, y, df = line
    got = fit_support(df, c=c, epsilon=epsilon)
    w, b = np.array(got.weights), got.intercept
    best, kept = slow(z, y, c, epsilon)
    assert objective(w, b, z, y, c, epsilon) <= best * 1.001
    assert w == pytest.approx(kept[0], abs=0.05) and b == pytest.approx(kept[1], abs=0.05)
    rows = df.collect()
    want = {round(float(r["_label"]), 9): float(np.array(r["_features"]) @ w + b) for r in rows}
    assert {round(r["_label"], 9): r["_prediction"] for r in got.transform(df).collect()} == pytest.approx(want)


def test_epsilon_is_a_dead_zone(line):
    """Inside the tube nothing pulls: a tube that holds all labels leaves a flat line, and the loss is zero there."""
    z, y, df = line
    flat = fit_support(df, c=10.0, epsilon=float(np.ptp(y)))
    assert np.abs(flat.weights).max() < 1e-6
    assert tube_loss(np.array([-0.3, 0.0, 0.2]), 0.3, 0.1).tolist() == [0, 0, 0]
    far = np.array([2.0, -5.0])
    assert tube_loss(far, 0.5, 1e-6) == pytest.approx(np.abs(far) - 0.5, abs=1e-6)
    with pytest.raises(ValueError):
        fit_support(df.limit(0), c=1.0, epsilon=0.1)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(2, 240))
    y = np.sin(2 * a) + 0.5 * b + rng.normal(scale=0.1, size=240)
    data = [(i, float(p), float(q), float(t) if i % 20 else None) for i, (p, q, t) in enumerate(zip(a, b, y))]
    return spark.createDataFrame(data, "id long, a double, b double, y double").repartition(3)


def test_kernel_model_learns_a_curve(spark, rows, tmp_path):
    pred, fitted = M.fit_predict(rows.filter("id < 180"), rows.filter("id >= 180"), NUM, "y", "svm")
    facts = pred.filter("y is not null").agg(F.avg(F.abs(F.col("y") - F.col("prediction"))), F.avg(F.abs("y")), F.count(F.lit(1))).first()
    assert facts[0] < 0.45 * facts[1]
    M.save_model(fitted, str(tmp_path / "m"), spark)
    loaded, _ = M.load_model(spark, str(tmp_path / "m"))
    same = loaded.predict(rows, "again").join(fitted.predict(rows, "first").select("id", "first"), "id")
    assert same.filter(F.abs(F.col("again") - F.col("first")) > 1e-12).count() == 0


def test_stacking(rows):
    """Out-of-fold predictions come from models without the row; the second level solves the normal equations of other folds."""
    candidates = (H.Candidate("line", "linear"), H.Candidate("ridge", "linear", {"reg_param": 0.5}), H.Candidate("tree", "rf", {"n_estimators": 5, "max_depth": 4}))
    table = H.out_of_fold_predictions(rows, NUM, "y", "id", candidates, n_folds=3, parallelism=4)
    t = table.toPandas().set_index("id")
    src = rows.filter("y is not null").toPandas().set_index("id")
    assert set(t.index) == set(src.index) and t["fold"].value_counts().to_dict() == {1: 76, 2: 76, 3: 76}
    x = lambda part: np.column_stack([np.ones(len(part)), part[["a", "b"]]])
    for fold in (1, 2, 3):
        train, own = src.loc[t.index[t["fold"] != fold]], src.loc[t.index[t["fold"] == fold]]
        w = np.linalg.lstsq(x(train), train["y"], rcond=None)[0]
        assert t.loc[own.index, "p_line"].to_numpy() == pytest.approx(x(own) @ w, abs=1e-6)
    names = [c.name for c in candidates]
    p = lambda part: np.column_stack([np.ones(len(part)), part[[f"p_{n}" for n in names]]])
    lines = H.stacking_weights(table, names, fold_col="fold")
    got = H.stacked_prediction(table, lines, fold_col="fold").toPandas().set_index("id")
    for fold in (1, 2, 3):
        train, own = t[t["fold"] != fold], t[t["fold"] == fold]
        w = np.linalg.lstsq(p(train), train["y"], rcond=None)[0]
        assert got.loc[own.index, "p_stacked"].to_numpy() == pytest.approx(p(own) @ w, abs=1e-6)
    board = H.stacked_leaderboard(table, names).collect()
    assert [r["cv_rmse"] for r in board] == sorted(r["cv_rmse"] for r in board) and {r["pipeline"] for r in board} == {*names, "ensemble", "stacked"}
    whole = H.stacking_weights(table, names)
    assert np.array([whole[None][0], *whole[None][1].values()]) == pytest.approx(np.linalg.lstsq(p(t), t["y"], rcond=None)[0], abs=1e-6)


def test_tune_fit_predict(rows):
    """Every trial's value is the mean over inner folds; the best is fitted on all known rows."""
    cfg = H.SearchConfig(True, n_trials=4, startup_trials=4, parallelism=2)
    train, asked = rows.filter("id < 200"), rows.filter("id >= 200")
    pred, fitted, trials = H.tuned_prediction(train, asked, NUM, "y", "id", "linear", cfg, split=SplitConfig(inner_folds=3))
    assert len(trials) == 4 and all(t.state == "complete" and len(t.running) == 3 for t in trials)
    best = min(trials, key=lambda t: (t.value, t.number))
    assert fitted.params["reg_param"] == best.params["reg_param"]
    direct = M.fit_model(train, NUM, "y", "linear", params=best.params)
    both = pred.join(direct.predict(asked, "direct").select("id", "direct"), "id")
    assert pred.columns == [*asked.columns, "prediction"]
    assert both.count() == 40 and both.filter(F.abs(F.col("prediction") - F.col("direct")) > 1e-12).count() == 0
    pred, fitted, trials = H.tuned_prediction(train, asked, NUM, "y", "id", "linear", H.SearchConfig(False), fixed={"reg_param": 0.3})
    assert trials == [] and fitted.params == {"reg_param": 0.3}
