import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from propspark.functions import scalars as S
from propspark.operators import lookups as L
from propspark.operators import rows as R
from propspark.operators import summaries as M
from propspark.operators.folds import SplitConfig
from propspark.plans import curate as C
from propspark.plans import evaluate as E
from propspark.plans import nested_cv as N
from propspark.plans import search as H
from propspark.plans.features import Feature
from propspark.plans.models import fit_model, fit_predict, load_model, make_estimator, save_model
from propspark.sources import tables as io


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return df.select(col).first()[0]


def test_scalars(spark):
    assert one(spark, S.clip_log10("y"), y=-5.0) == 0.0
    assert one(spark, S.clip_log10(F.lit(None).cast("double")), y=1.0) is None
    assert one(spark, S.scale_where("v", "u", "mL.min-1.g-1", 1.028), v=10.0, u="mL.min-1.g-1") == pytest.approx(10.28)
    assert one(spark, S.scale_where("v", "u", "mL.min-1.g-1", 1.028), v=10.0, u="mL.min-1.kg-1") == 10.0
    assert one(spark, S.to_number("s"), s="1e3") == 1000.0 and one(spark, S.to_number("s"), s="x") is None and one(spark, S.to_number("s"), s="NaN") is None
    assert one(spark, S.to_bool("s"), s=" ON ") is True and one(spark, S.to_bool(F.lit(None).cast("string"), False), s="") is False
    with pytest.raises(Exception, match="not a boolean"):
        one(spark, S.to_bool("s"), s="maybe")
    assert S.prefer_literal(" False ") is False and S.prefer_literal("None") is None and S.prefer_literal("x") == "x"


def test_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "f_b double, f_a double")
    assert [tuple(r) for r in R.align_columns(df, ["f_a", "f_missing", "f_b"]).collect()] == [(2.0, None, 1.0), (4.0, None, 3.0)]
    keyed = spark.createDataFrame([("a", 1.0), (None, 2.0), ("b", None)], "k string, v double")
    assert [r["k"] for r in R.exclude_values(keyed, "k", ["a"]).collect()] == [None, "b"]
    assert [r["k"] for r in R.exclude_values(keyed, "k", ["a"], value_col="v").collect()] == [None]
    with pytest.raises(ValueError):
        R.membership_split(keyed, "k", ["zzz"])
    with pytest.raises(ValueError):
        R.complete_rows(keyed, ["nope"])
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    assert sorted([r["v"] for r in io.nan_to_null(nan).collect()], key=str) == [1.0, None]


def test_lookup_uses_last_row(spark):
    fact = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    dim = spark.createDataFrame([("a", "old", 1), ("a", "new", 2)], "id string, name string, v int")
    got = L.lookup(fact, L.last_written(dim, "id", ["v"]), "k", "id", {"name": "label"}, hit="found").collect()
    assert {(r["k"], r["label"], r["found"]) for r in got} == {("a", "new", True), ("b", None, False), (None, None, False)}
    with pytest.raises(ValueError):
        L.last_written(dim, "id", [])


def test_summaries(spark):
    folds = spark.createDataFrame([("rf", "x", 1, 2.0)], "model string, feature_set string, outer_fold int, rmse double")
    assert M.fold_summary(folds, ["rmse"]).first()["rmse_std"] == 0.0
    flat = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [r["n"] for r in M.histogram(flat, "v", 3).orderBy("bin").collect()] == [2, 0, 0]
    two = spark.createDataFrame([("a", "x", 0.1), ("b", "x", 0.9)], "model string, feature_set string, r2_mean double")
    assert M.best_combination(two, "r2").first()["model"] == "b"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, "x", 1.0), (1, "y", None)], "`Unnamed: 0` int, k string, v double")
    io.write_table(df, f"{tmp_path}/t.csv", fmt="csv")
    back = io.read_table(spark, f"{tmp_path}/t.csv", schema="`Unnamed: 0` int, k string, v double", required=["k"])
    assert back.columns == ["k", "v"] and back.count() == 2
    with pytest.raises(ValueError):
        io.read_table(spark, f"{tmp_path}/t.csv", required=["absent"])
    io.write_buckets(df.drop("Unnamed: 0"), f"{tmp_path}/b", "k")
    assert sorted(p.name for p in (tmp_path / "b").iterdir() if p.is_dir()) == ["k=x", "k=y"]


def test_curation(spark):
    raw = spark.createDataFrame([("s1", 10.0, "m1", None, "mL.min-1.g-1"), ("s2", 10.0, "m2", None, "mL.min-1.kg-1"), ("s3", 5.0, "m3", "odd", "mL.min-1.kg-1"),
                                 ("s4", None, "m4", None, "mL.min-1.kg-1"), ("s5", 1.0, "m5", None, "uL/min")], "smiles string, v double, mol string, remark string, unit string")
    cfg = C.SourceConfig("c", ("smiles", "v", "mol"), "v", flag_col="remark", unit_col="unit", units=("mL.min-1.kg-1", "mL.min-1.g-1"),
                         scaled_unit="mL.min-1.g-1", factor=1.028, renames={"smiles": "SMILES", "mol": "mol_id"})
    src = C.prepare_source(raw, cfg).withColumn("scaling_was_applied", S.mapped("unit", {"mL.min-1.kg-1": False, "mL.min-1.g-1": True}))
    got = {r["mol_id"]: r for r in src.collect()}
    assert set(got) == {"m1", "m2"}
    assert got["m1"]["hlm_value_scaled"] == pytest.approx(10.28) and got["m2"]["hlm_value_scaled_log1p"] == pytest.approx(math.log(11))
    other = src.filter("mol_id = 'm1'").withColumn("scaling_was_applied", F.lit(" False")).withColumn("dataset", F.lit("d")).withColumn("extra", F.lit(1))
    sets = C.training_sets({"c": src, "d": other}, single="d", predicted=other)
    assert {n: s.count() for n, s in sets.items()} == {"all": 3, "no_scaling": 2, "single": 1, "all_predicted": 4}
    assert "extra" in sets["all_predicted"].columns and list(sets["all"].columns) == list(C.CANONICAL_COLUMNS)


def test_evaluation(spark):
    rng = np.random.default_rng(0)
    true = spark.createDataFrame([(f"m{i}", float(v)) for i, v in enumerate(rng.gamma(2.0, 20.0, 40))], "name string, t double")
    good = true.select("name", (F.col("t") * 1.1).alias("y_pred_normal"))
    bad = true.select("name", F.log1p(F.col("t") * 0 + F.hash("name") % 50).alias("y_pred_log1p"))
    out = E.compare_models({"bad": bad, "good": good}, true, "name", "t", samples=20).collect()
    assert [(r["Rank"], r["Name"]) for r in out] == [(1, "good"), (2, "bad")]
    assert out[0]["mean_Spearman R"] == pytest.approx(1.0)
    with pytest.raises(ValueError, match="lack"):
        E.compare_models({"x": good.filter("name <> 'm3'")}, true, "name", "t")
    with pytest.raises(ValueError, match="duplicated"):
        E.compare_models({"x": good.union(good)}, true, "name", "t")
    with pytest.raises(ValueError, match="must contain"):
        E.natural_predictions(true, "name", "HLM")


@pytest.fixture(scope="module")
def xy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(100, 8))
    y = x @ rng.normal(size=8) + 0.1 * rng.normal(size=100)
    rows = [(i, r.tolist(), float(v), float(r[0]) if i % 9 else None, float(r[1])) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, x array<double>, y double, a double, b double").cache()


X = (Feature("x", "dense", "x", width=8),)
PARAMS = {"rf": {"n_estimators": 5, "max_depth": 4}, "xgb": {"n_estimators": 3, "max_depth": 3}, "lgbm": {"n_estimators": 3}, "svm": {"n_components": 32}, "linear": {}}


@pytest.mark.parametrize("model", list(PARAMS))
def test_models(xy, model):
    pred, _ = fit_predict(xy.filter("id < 80"), xy.filter("id >= 80"), X, "y", model, params=PARAMS[model])
    a = [r["prediction"] for r in pred.orderBy("id").collect()]
    assert len(a) == 20 and np.isfinite(a).all()
    again, _ = fit_predict(xy.filter("id < 80"), xy.filter("id >= 80"), X, "y", model, params=PARAMS[model])
    assert a == pytest.approx([r["prediction"] for r in again.orderBy("id").collect()])


def test_model_errors():
    with pytest.raises(ValueError, match="unknown model"):
        make_estimator("nope")
    with pytest.raises(ValueError, match="no parameters"):
        make_estimator("xgb", {"reg_alpha": 1})


def test_gaps_are_filled_from_training_rows(xy):
    f = (Feature("num", "numeric", "a", columns=("a", "b")),)
    train = xy.filter("id < 80")
    fitted = fit_model(train, f, "y", "linear")
    want = np.nanmedian([r["a"] if r["a"] is not None else np.nan for r in train.collect()])
    # Every column keeps its training median: rows to be scored may have gaps where these have none.
    assert fitted.medians == {"a": pytest.approx(want), "b": pytest.approx(np.median([r["b"] for r in train.collect()]))} and fitted.numbers == ["a", "b"]


def test_save_load_score(spark, xy, tmp_path):
    fitted = fit_model(xy, X, "y", "svm", params=PARAMS["svm"])
    path = save_model(fitted, f"{tmp_path}/refit", spark, feature_set="x")
    loaded, meta = load_model(spark, path)
    assert meta["feature_set"] == "x" and len(meta["feature_names"]) == 8
    rows = xy.withColumn("key", F.when(F.col("id") != 3, F.lit("k")))
    a = {r["id"]: r["prediction"] for r in N.score_table(loaded, rows, key_column="key").collect()}
    b = {r["id"]: r["prediction"] for r in fitted.predict(xy).collect()}
    assert a.pop(3) is None
    assert all(a[i] == pytest.approx(b[i]) for i in a)
    xy.write.parquet(f"{tmp_path}/in")
    out = N.predict_from_refit(spark, input_path=f"{tmp_path}/in", refit_dir=path, output_path=f"{tmp_path}/out", key_column="x")
    assert out.columns == [*xy.columns, "prediction"] and spark.read.parquet(f"{tmp_path}/out").count() == 100
    with pytest.raises(ValueError):
        N.score_table(loaded, rows, key_column="absent")
    with pytest.raises(FileNotFoundError, match="metadata"):
        load_model(spark, f"{tmp_path}/nothing")
    (tmp_path / "refit" / "best_model_other").mkdir()
    with pytest.raises(ValueError, match="exactly one"):
        load_model(spark, path)


def test_search_and_pruning(xy):
    cfg = H.SearchConfig(True, n_trials=3, space={"n_estimators": ("int", 2, 6, 2), "max_depth": ("choice", (2, 3))})
    from propspark.operators.folds import random_folds

    rows = random_folds(xy, "id", 3, name="_inner")
    best, trials = H.tune(rows, X, "y", "rf", cfg, split=SplitConfig("random"), n_folds=3)
    assert len(trials) == 3 and best == min(trials, key=lambda t: t.value).params
    assert H.draw_params(H.SPACES["rf"], 0, 4) == H.draw_params(H.SPACES["rf"], 0, 4)
    done = [H.Trial(i, {}, [1.0, 1.0], "complete") for i in range(5)]
    worse = H.Trial(9, {}, [2.0, 2.0])
    assert H.should_prune(worse, done, H.SearchConfig())
    assert not H.should_prune(worse, done[:4], H.SearchConfig())
    assert not H.should_prune(H.Trial(9, {}, [2.0]), done, H.SearchConfig())
    assert not H.should_prune(worse, done, H.SearchConfig(metric="r2"))


def test_leaderboard_and_ensemble(spark, xy):
    cands = [H.Candidate("rf", "rf", PARAMS["rf"]), H.Candidate("linear", "linear")]
    tab, fitted = H.candidate_predictions(xy.filter("id < 80"), xy.filter("id >= 80"), X, "y", "id", cands)
    board = H.leaderboard(tab, list(fitted))
    assert board.columns == ["pipeline", "cv_score", "cv_rmse"]
    got = [r["cv_rmse"] for r in board.collect()]
    assert got == sorted(got)
    report = H.best_model_report(tab, fitted)
    assert report["best_model"] == board.first()["pipeline"] and len(report["metrics"]) == 8
    pdf = spark.createDataFrame([(float(i), i + 1.0, i - 1.0, i + 5.0) for i in range(10)], "y double, p_a double, p_b double, p_c double")
    w = H.ensemble_weights(pdf, ["a", "b", "c"], rounds=10)
    assert w == {"a": 0.5, "b": 0.5, "c": 0.0}
    assert H.leaderboard(H.ensemble_prediction(pdf, w), ["a", "ensemble"]).first()["cv_rmse"] == pytest.approx(0.0)


def test_nested_cv(spark, xy, tmp_path):
    cfg = N.RunConfig("x", "y", "id", {"x": X}, models=("rf", "linear"), metrics=("rmse", "mae"), split=SplitConfig("random", outer_folds=2, inner_folds=2),
                      search=H.SearchConfig(True, n_trials=1, space=None), model_params={"rf": PARAMS["rf"] | {"min_samples_leaf": 1, "max_features": 1.0, "bootstrap": True}})
    res = N.run_nested_cv(xy, cfg)
    folds = res.folds.collect()
    assert len(folds) == 4 and all(r["n_train"] + r["n_test"] == 100 for r in folds)
    preds = res.predictions.filter("model = 'rf'")
    assert preds.count() == 100 and preds.select("row_id").distinct().count() == 100
    assert res.best_row["model"] == "linear" and res.refit is not None
    N.save_cv(res, f"{tmp_path}/cv", spark)
    assert load_model(spark, f"{tmp_path}/cv/refit")[1]["summary_row"]["model"] == "linear"
    assert spark.read.parquet(f"{tmp_path}/cv/predictions").count() == 200
    with pytest.raises(ValueError):
        N.run_nested_cv(xy, N.RunConfig("x", "absent", "id", {"x": X}))
