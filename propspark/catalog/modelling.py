"""Feature assembly, models, search, cross-validation and scoring queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from propspark.catalog.base import FOLD_PAIRS, PRICE_PAIRS, fold_pairs, price_pairs, r6, scratch, table
from propspark.catalog.text import chars_sql
from propspark.operators.folds import SplitConfig, holdout, random_folds
from propspark.operators.rows import union_all
from propspark.plans import nested_cv as N
from propspark.plans import search as H
from propspark.plans.features import Feature, assemble, featurize
from propspark.plans.models import fit_model, fit_predict, load_model, save_model
from propspark.session import cut_lineage

EMB = (Feature("embedding", "dense", "embedding", width=64),)
REDUCED = (Feature("reduced", "dense", "embedding", width=64, reduce_to=16),)
SMALL_RF = {"n_estimators": 10, "max_depth": 5}
SMALL_GBT = {"n_estimators": 5, "max_depth": 3, "learning_rate": 0.1}


def _vectors(spark, root):
    """Vectors with their label as the value to predict."""
    return table(spark, root, "embeddings").withColumn("label", F.col("label").cast("double"))


def assembled_features(spark, root):
    """Fingerprint, profile and dense blocks side by side."""
    docs = table(spark, root, "documents").select("doc_id", "text")
    feats = (Feature("chars", "substructure", "text", n_bits=512), Feature("prof", "profile", "text"))
    rows = assemble(featurize(docs, feats), feats, feats[1].numbers)
    v = vector_to_array("_features")
    return rows.select("doc_id", F.size(v).cast("bigint").alias("width"),
                       F.aggregate(F.slice(v, 1, 512), F.lit(0.0), lambda a, x: a + x).cast("bigint").alias("n_on"))


def _model(spark, root, model, params):
    rows = holdout(_vectors(spark, root), "vec_id", SplitConfig("random"), 0.2)
    pred, _ = fit_predict(rows.filter("NOT is_valid"), rows.filter("is_valid"), EMB, "label", model, params=params)
    return pred.select("vec_id", "label", "prediction")


def random_forest(spark, root):
    return _model(spark, root, "rf", SMALL_RF)


def gradient_boosting(spark, root):
    return _model(spark, root, "xgb", SMALL_GBT)


def kernel_regression(spark, root):
    return _model(spark, root, "svm", {"n_components": 64})


CANDIDATES = (H.Candidate("rf", "rf", SMALL_RF), H.Candidate("gbt", "lgbm", SMALL_GBT), H.Candidate("svm", "svm", {"n_components": 64}),
              H.Candidate("linear", "linear", {"reg_param": 0.1}))


def leaderboard_models(spark, root):
    """Candidates and their greedy ensemble on a hold-out."""
    rows = holdout(_vectors(spark, root), "vec_id", SplitConfig("random"), 0.2)
    tab, fitted = H.candidate_predictions(rows.filter("NOT is_valid"), rows.filter("is_valid"), EMB, "label", "vec_id", CANDIDATES)
    tab = H.ensemble_prediction(tab, H.ensemble_weights(tab, list(fitted)))
    return H.leaderboard(tab, [*fitted, "ensemble"])


def stored_leaderboard(spark, root):
    """Ranking of stored predictions: three simple price rules."""
    p = price_pairs(spark, root)
    tab = p.select(F.col("y_true").alias("y"), F.col("y_pred").alias("p_list"), (F.col("l_quantity") * 1000).alias("p_flat"),
                   (F.col("y_pred") * (1 - F.col("l_discount"))).alias("p_discounted"))
    return H.leaderboard(tab, ["list", "flat", "discounted"]).select("pipeline", F.round(F.col("cv_score") / 1e6, 6).alias("cv_score"), r6("cv_rmse"))


def parameter_search(spark, root):
    cfg = H.SearchConfig(True, n_trials=4, startup_trials=2, space={"n_estimators": ("int", 5, 15, 5), "max_depth": ("int", 2, 6, 1)})
    rows = cut_lineage(random_folds(_vectors(spark, root), "vec_id", 3, name="_inner"))
    _, trials = H.tune(rows, EMB, "label", "rf", cfg, split=SplitConfig("random"), n_folds=3)
    return H.trials_table(rows, trials)


TUNING = H.SearchConfig(True, n_trials=6, startup_trials=6, parallelism=6)


def tuned_prediction(spark, root):
    """Tune, fit and predict in one call over the whole space of the line, with five inner folds."""
    rows = table(spark, root, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("item"), "l_linenumber", F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").alias("price"))
    line = (Feature("num", "numeric", "q", columns=("q",)),)
    out, _, _ = H.tuned_prediction(rows.filter("l_linenumber <= 3"), rows.filter("l_linenumber > 3"), line, "price", "item", "linear", TUNING)
    return out.select("item", F.round("prediction", 2).alias("prediction"))


def stacked_leaderboard(spark, root):
    """Two stored predictions and their second level, each fold's line from the rows of all other folds."""
    p = price_pairs(spark, root)
    tab = cut_lineage(p.select(F.col("l_linenumber").alias("fold"), F.col("y_true").alias("y"), F.col("y_pred").alias("p_list"), (F.col("l_quantity") * 1000).alias("p_flat")))
    board = H.stacked_leaderboard(tab, ["list", "flat"])
    return board.filter("pipeline <> 'ensemble'").select("pipeline", F.round(F.col("cv_score") / 1e6, 6).alias("cv_score"), r6("cv_rmse"))


def _run(**kw):
    base = dict(key_column="embedding", target_column="label", id_column="vec_id", feature_sets={"emb": EMB, "reduced": REDUCED}, models=("rf", "linear"),
                metrics=("rmse", "mae", "r2", "spearman_rho"), split=SplitConfig("random", outer_folds=3), model_params={"rf": SMALL_RF}, parallelism=3)
    return N.RunConfig(**{**base, **kw})


def nested_cv(spark, root):
    return N.run_nested_cv(_vectors(spark, root), _run()).summary


def nested_cv_time(spark, root):
    """Expanding windows: each fold is scored by a model that has seen only earlier rows."""
    e = table(spark, root, "events").withColumn("hour", F.hour("ts").cast("double")).withColumn("kind", F.length("event_type").cast("double"))
    cfg = _run(key_column="event_id", target_column="value", id_column="event_id", feature_sets={"num": (Feature("num", "numeric", "hour", columns=("hour", "kind", "user_id")),)},
               models=("linear",), metrics=("rmse", "mae"), split=SplitConfig("time_series", outer_folds=3, time_column="ts"), refit_best_model=False)
    return N.run_nested_cv(e, cfg).folds


def nested_cv_scores(spark, root):
    """Fold scores and summary from stored out-of-fold predictions."""
    _, summary = N.score_predictions(fold_pairs(spark, root), ["rmse", "mae", "r2"])
    return summary.select("model", "feature_set", *[r6(c) for c in summary.columns[2:]])


def batch_scoring(spark, root):
    """Fit, save, load and score; every input column is kept, rows without a key get no prediction."""
    train = _vectors(spark, root)
    _, fitted = fit_predict(train, train, EMB, "label", "rf", params=SMALL_RF)
    loaded, _ = load_model(spark, save_model(fitted, scratch(spark) + "/refit", spark, feature_set="emb"))
    rows = train.withColumn("key", F.when(F.col("label") != 3, F.col("vec_id")))
    return N.score_table(loaded, rows, key_column="key").select("vec_id", "label", "prediction")


def scored_gaps(spark, root):
    """A line fitted on complete rows; rows without the input are scored at its training median."""
    rows = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").alias("price"))
    line = (Feature("num", "numeric", "q", columns=("q",)),)
    fitted = fit_model(rows.filter("l_linenumber <= 3"), line, "price", "linear")
    asked = rows.filter("l_linenumber > 3").withColumn("q", F.when(F.col("l_linenumber") != 5, F.col("q")))
    return fitted.predict(asked).select("l_orderkey", "l_linenumber", F.round("prediction", 2).alias("prediction"))


def model_facts(spark, root):
    """What must hold for every model's hold-out predictions: all rows, none missing, and for trees inside the labels' range."""
    rows = cut_lineage(holdout(_vectors(spark, root), "vec_id", SplitConfig("random"), 0.2))
    train, valid = rows.filter("NOT is_valid"), rows.filter("is_valid")
    tab, _ = H.candidate_predictions(train, valid, EMB, "label", "vec_id", CANDIDATES)
    low, high = train.agg(F.min("label"), F.max("label")).first()
    long = tab.select("vec_id", F.inline(F.array(*[F.struct(F.lit(c.name).alias("model"), F.col(f"p_{c.name}").alias("p")) for c in CANDIDATES])))
    inside = F.when(F.col("model") == "rf", F.bool_and(F.col("p").between(low, high)))
    return long.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("ids"), F.count_if(F.col("p").isNull() | F.isnan("p")).alias("n_missing"), inside.alias("inside"))


def scoring_facts(spark, root):
    """A saved and loaded model scores as the unsaved one; rows without a key get nothing."""
    train = _vectors(spark, root)
    fitted = fit_model(train, EMB, "label", "linear", params={"reg_param": 0.1})
    loaded, meta = load_model(spark, save_model(fitted, scratch(spark) + "/refit", spark, feature_set="emb"))
    rows = train.withColumn("key", F.when(F.col("label") != 3, F.col("vec_id")))
    both = N.score_table(fitted, N.score_table(loaded, rows, key_column="key"), key_column="key", prediction_column="direct")
    return both.select("vec_id", F.col("prediction").isNull().alias("no_prediction"), F.col("prediction").eqNullSafe(F.col("direct")).alias("same"),
                       F.lit(len(meta["feature_names"])).cast("bigint").alias("n_features"))


SEARCH = H.SearchConfig(True, n_trials=2, startup_trials=1, space={"n_estimators": ("int", 3, 9, 2), "max_depth": ("mode", {"none": 30, "int": ("int", 2, 5, 1)})})


def _searched(spark, root):
    split = SplitConfig("random", outer_folds=5, inner_folds=2)
    cfg = _run(feature_sets={"reduced": REDUCED}, models=("rf",), split=split, search=SEARCH, model_params={}, parallelism=5, metrics=("rmse", "mae"))
    return N.run_nested_cv(_vectors(spark, root), cfg)


def nested_cv_search(spark, root):
    """Every outer fold searches its parameters on its own training rows; scores are recomputed from the stored predictions."""
    got = _searched(spark, root)
    again = got.predictions.groupBy("outer_fold").agg(F.sqrt(F.avg((F.col("y_true") - F.col("y_pred")) ** 2)).alias("again"), F.sum("row_id").alias("ids"))
    found = [len(p) for p in got.best_params["rf__reduced"]]
    return got.folds.join(again, "outer_fold").select(
        "outer_fold", "n_train", "n_test", "ids", (F.abs(F.col("rmse") - F.col("again")) < 1e-9).alias("rmse_agrees"), F.lit(min(found)).cast("bigint").alias("n_searched"))


def cv_artifacts(spark, root):
    """All tables of a run, written and read back, with their row counts."""
    path = scratch(spark)
    N.save_cv(_searched(spark, root), path, spark)
    names = ("fold_results", "summary", "predictions", "best_params", "feature_names")
    return union_all([spark.read.parquet(f"{path}/{n}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("artifact"), "n") for n in names])


QUERIES = {f.__name__: f for f in (
    assembled_features, random_forest, gradient_boosting, kernel_regression, leaderboard_models, stored_leaderboard, parameter_search, tuned_prediction, stacked_leaderboard,
    nested_cv, nested_cv_time, nested_cv_scores, batch_scoring,
    scored_gaps, model_facts, scoring_facts, nested_cv_search, cv_artifacts,
)}

_RMSE = "sqrt(avg(pow(y_true - y_pred, 2)))"
_DRAWN = ", ".join(f"{H.draw_params(H.SPACES['linear'], TUNING.random_state, i)['reg_param']!r}::double" for i in range(TUNING.n_trials))


def tuned_sql() -> str:
    """The line by its closed form for every drawn penalty and inner fold; the penalty with the least mean error predicts."""
    fit = lambda by: f"""regr_slope(y, q) / (1 + lam / stddev_samp(y)) as b, avg(y) as my, avg(q) as mq {by}"""
    return f"""with i as (select l_orderkey || '-' || l_linenumber as item, l_linenumber as k, l_quantity::double as q, l_extendedprice::double as y from lineitem),
        t as materialized (select *, ntile(5) over (order by md5('0:' || item), item) as fold from i where k <= 3), l as (select unnest([{_DRAWN}]) as lam),
        m as (select lam, f.fold, {fit('')} from t, l, range(1, 6) f(fold) where t.fold <> f.fold group by lam, f.fold),
        s as (select lam, m.fold, sqrt(avg(pow(y - (my + b * (q - mq)), 2))) as rmse from t join m on t.fold = m.fold group by all),
        best as (select lam from (select lam, avg(rmse) as e from s group by lam) order by e limit 1), w as (select lam, {fit('')} from t, best group by lam)
        select item, round(my + b * (q - mq), 2) as prediction from i, w where k > 3"""


STACKED_SQL = f"""with p as materialized (select l_linenumber as fold, y_true as y, y_pred as a, l_quantity * 1000 as b from {PRICE_PAIRS}), f as (select distinct fold from p),
    c as (select f.fold, avg(a) as ma, avg(b) as mb, avg(y) as my, var_pop(a) as aa, var_pop(b) as bb, covar_pop(a, b) as ab, covar_pop(a, y) as ya, covar_pop(b, y) as yb
      from f join p on p.fold <> f.fold group by all),
    w as (select *, (ya * bb - yb * ab) / (aa * bb - ab * ab) as wa, (yb * aa - ya * ab) / (aa * bb - ab * ab) as wb from c),
    e as (select unnest(['list', 'flat', 'stacked']) as pipeline, unnest([a, b, my + wa * (a - ma) + wb * (b - mb)]) - y as d from p join w using (fold))
    select pipeline, round(-avg(d * d) / 1e6::double, 6) as cv_score, round(sqrt(avg(d * d)), 6) as cv_rmse from e group by 1"""
ORACLES = {
    "assembled_features": f"""select t.doc_id, 521::bigint as width, count(b) as n_on from documents t
        left join {chars_sql('documents', 'doc_id', 512)} x on x.doc_id = t.doc_id group by 1""",
    "stored_leaderboard": """with e as (select unnest(['list', 'flat', 'discounted']) as pipeline, unnest([l_quantity * p_retailprice, l_quantity * 1000, l_quantity * p_retailprice * (1 - l_discount)])
        - l_extendedprice as d from lineitem join part on l_partkey = p_partkey)
        select pipeline, round(-avg(d * d) / 1e6::double, 6) as cv_score, round(sqrt(avg(d * d)), 6) as cv_rmse from e group by 1""",
    "tuned_prediction": tuned_sql(),
    "stacked_leaderboard": STACKED_SQL,
    "nested_cv_scores": f"""with p as {FOLD_PAIRS}, m as (select model as a, feature_set as b, outer_fold as c, avg(y_true) as mu from p group by all),
        f as (select model, feature_set, outer_fold, {_RMSE} as rmse, avg(abs(y_true - y_pred)) as mae, 1 - sum(pow(y_true - y_pred, 2)) / sum(pow(y_true - mu, 2)) as r2
          from p join m on a = model and b = feature_set and c = outer_fold group by all)
        select model, feature_set, {', '.join(f'round(avg({x}), 6) as {x}_mean, round(coalesce(stddev_samp({x}), 0), 6) as {x}_std' for x in ('rmse', 'mae', 'r2'))} from f group by 1, 2""",
    "scored_gaps": """with t as (select regr_slope(l_extendedprice, l_quantity) b, regr_intercept(l_extendedprice, l_quantity) a, median(l_quantity) m from lineitem where l_linenumber <= 3)
        select l_orderkey, l_linenumber, round(a + b * case when l_linenumber = 5 then m else l_quantity end, 2) as prediction from lineitem, t where l_linenumber > 3""",
    "model_facts": """with h as (select vec_id, row_number() over (order by md5('0:' || vec_id), vec_id) <= (select ceil(count(*) * 0.2) from embeddings) as v from embeddings)
        select model, count(*) as n, sum(vec_id)::bigint as ids, 0 as n_missing, case when model = 'rf' then true end as inside
        from h, (values ('rf'), ('gbt'), ('svm'), ('linear')) m(model) where v group by 1""",
    "scoring_facts": "select vec_id, label = 3 as no_prediction, true as same, 64 as n_features from embeddings",
    "nested_cv_search": """with f as (select vec_id, ntile(5) over (order by md5('0:' || vec_id), vec_id) as fold from embeddings)
        select fold as outer_fold, (select count(*) from embeddings) - count(*) as n_train, count(*) as n_test, sum(vec_id)::bigint as ids, true as rmse_agrees, 2 as n_searched from f group by 1""",
    "cv_artifacts": "select 'predictions' as artifact, count(*) as n from embeddings union all values ('fold_results', 5), ('summary', 1), ('best_params', 5), ('feature_names', 16)",
}
