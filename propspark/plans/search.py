"""Seeded random search over parameter spaces with median pruning, and model leaderboards."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from statistics import median
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propspark.operators.folds import SplitConfig, assign_folds, train_test
from propspark.operators.metrics import ERROR_METRICS, KENDALL_METRICS, SPEARMAN_METRICS, metric_table
from propspark.operators.rows import union_all
from propspark.operators.summaries import HIGHER_BETTER
from propspark.plans.features import Feature
from propspark.plans.models import DEFAULTS, MAX_DEPTH, FittedModel, fit_model
from propspark.session import cut_lineage

REPORT = (*ERROR_METRICS, "r2", *KENDALL_METRICS, *SPEARMAN_METRICS)

# Search spaces. ("int", low, high, step), ("float", low, high), ("log", low, high), ("choice", values), and
# ("mode", {name: spec or value}): first a mode, then, where it is a spec, a value. Ranges are fixed values
# but for these: depths end at MLlib's limit, and having no limit means that depth; the weight of a leaf
# becomes its number of rows.
SPACES: dict[str, dict[str, tuple]] = {
    "rf": {
        "n_estimators": ("int", 200, 2000, 100),
        "max_depth": ("mode", {"none": MAX_DEPTH, "int": ("int", 2, MAX_DEPTH, 1)}),
        "min_samples_leaf": ("int", 1, 20, 1),
        "max_features": ("mode", {"sqrt": "sqrt", "log2": "log2", "fraction": ("float", 0.1, 1.0)}),
        "bootstrap": ("choice", (True, False)),
    },
    "svm": {
        "C": ("log", 1e-2, 1e3),
        "epsilon": ("log", 1e-4, 1.0),
        "gamma": ("mode", {"scale": "scale", "auto": "auto", "value": ("log", 1e-6, 1e-1)}),
    },
    "xgb": {
        "n_estimators": ("int", 300, 6000, 100),
        "learning_rate": ("log", 5e-3, 0.3),
        "max_depth": ("int", 2, 12, 1),
        "min_instances": ("int", 1, 20, 1),
        "subsample": ("float", 0.5, 1.0),
    },
    "lgbm": {
        "n_estimators": ("int", 500, 10000, 250),
        "learning_rate": ("log", 5e-3, 0.2),
        "max_depth": ("mode", {"none": MAX_DEPTH, "int": ("int", 3, 20, 1)}),
        "min_instances": ("int", 5, 60, 1),
        "subsample": ("float", 0.5, 1.0),
    },
    "linear": {"reg_param": ("log", 1e-6, 10.0)},
}


@dataclass(frozen=True)
class SearchConfig:
    enabled: bool = False
    metric: str = "rmse"
    n_trials: int = 30
    random_state: int = 0
    startup_trials: int = 5
    warmup_folds: int = 1
    parallelism: int = 1
    timeout_s: float | None = None
    space: Mapping[str, tuple] | None = None


@dataclass
class Trial:
    number: int
    params: dict[str, Any]
    running: list[float] = field(default_factory=list)
    state: str = "running"

    @property
    def value(self) -> float | None:
        return self.running[-1] if self.state == "complete" else None


def draw_params(space: Mapping[str, tuple], seed: int, number: int) -> dict[str, Any]:
    """Parameters of one trial; they depend on seed and trial number only."""
    rng = np.random.default_rng([seed, number])

    def draw(kind: str, *spec):
        if kind == "int":
            low, high, step = spec
            return int(low + step * rng.integers(0, (high - low) // step + 1))
        if kind == "float":
            return float(rng.uniform(*spec))
        if kind == "log":
            return float(np.exp(rng.uniform(np.log(spec[0]), np.log(spec[1]))))
        choices = list(spec[0].values() if kind == "mode" else spec[0])
        picked = choices[int(rng.integers(0, len(choices)))]
        return draw(*picked) if kind == "mode" and isinstance(picked, tuple) else picked

    return {name: draw(*spec) for name, spec in space.items()}


def should_prune(trial: Trial, done: Sequence[Trial], cfg: SearchConfig) -> bool:
    """Worse than the median of earlier trials at the same fold; never in the first trials or folds."""
    step = len(trial.running) - 1
    if len(done) < cfg.startup_trials or step < cfg.warmup_folds:
        return False
    others = [t.running[step] for t in done if len(t.running) > step]
    if not others:
        return False
    mid = median(others)
    return trial.running[-1] < mid if cfg.metric in HIGHER_BETTER else trial.running[-1] > mid


def score(df: DataFrame, y: str, p: str, metric: str) -> float:
    return float(metric_table(df, y, p, metrics=[metric]).first()[metric])


def tune(
    train: DataFrame, features: Sequence[Feature], target: str, model: str, cfg: SearchConfig, *,
    split: SplitConfig, n_folds: int, fold_col: str = "_inner", fixed: dict | None = None, seed: int = 0,
) -> tuple[dict[str, Any], list[Trial]]:
    """Best parameters over inner folds of the training rows. ``fold_col`` is a column of ``train``.

    The driver only holds parameters and scores; every fit and score is a Spark job. ``parallelism`` trials
    are submitted at once, as a round; a trial is pruned against the trials of earlier rounds only, so the
    result depends on seed and ``parallelism``, not on which trial ends first. After ``timeout_s`` seconds no
    further round begins (the first always runs); the number of trials then depends on the time taken.
    """
    if model not in SPACES:
        raise ValueError(f"no search space for {model}")
    space = {k: v for k, v in (cfg.space or SPACES[model]).items() if k not in (fixed or {})}
    trials: list[Trial] = []

    def run(number: int) -> Trial:
        trial = Trial(number, {**(fixed or {}), **draw_params(space, cfg.random_state, number)})
        scores = []
        for fold in range(1, n_folds + 1):
            tr, va = train_test(train, split, fold, name=fold_col)
            fitted = fit_model(tr, features, target, model, params=trial.params, seed=seed)
            scores.append(score(fitted.predict(va, "_p"), target, "_p", cfg.metric))
            trial.running.append(sum(scores) / len(scores))
            if fold < n_folds and should_prune(trial, trials, cfg):
                trial.state = "pruned"
                break
        else:
            trial.state = "complete"
        return trial

    def pooled(number: int) -> Trial:
        # Where the scheduler is fair, trials of a round share the cluster instead of queueing behind each other.
        train.sparkSession.sparkContext.setLocalProperty("spark.scheduler.pool", f"{model}-trial-{number}")
        return run(number)

    began, width = time.monotonic(), max(1, cfg.parallelism)
    with ThreadPoolExecutor(width) as pool:
        for first in range(0, cfg.n_trials, width):
            if first and cfg.timeout_s is not None and time.monotonic() - began >= cfg.timeout_s:
                break
            trials += list(pool.map(pooled, range(first, min(first + width, cfg.n_trials))))
    complete = [t for t in trials if t.state == "complete"]
    sign = -1.0 if cfg.metric in HIGHER_BETTER else 1.0
    best = min(complete, key=lambda t: (sign * t.value, t.number))
    return {k: v for k, v in best.params.items() if k not in (fixed or {})}, trials


def tuned_prediction(train: DataFrame, rows: DataFrame, features: Sequence[Feature], target: str, id_col: str, model: str, cfg: SearchConfig, *,
                     split: SplitConfig = SplitConfig(), fixed: dict | None = None, seed: int = 0, column: str = "prediction",
                     ) -> tuple[DataFrame, FittedModel, list[Trial]]:
    """Tune on inner folds of the training rows, fit them all with the best parameters, and predict ``rows``.

    Gives all columns of ``rows`` plus the prediction, the fitted model (its ``params`` hold what was found) and the
    trials. Training rows without a target are left out before folds are made. With the search switched off
    the model's defaults and ``fixed`` are used and there are no trials.
    """
    known = train.filter(F.col(target).isNotNull())
    found, trials = {}, []
    if cfg.enabled:
        folded = cut_lineage(assign_folds(known, id_col, split, split.inner_folds, name="_inner"))
        n = folded.agg(F.max("_inner")).first()[0]
        found, trials = tune(folded, features, target, model, cfg, split=split, n_folds=n, fixed=fixed, seed=seed)
    fitted = fit_model(known, features, target, model, params={**(fixed or {}), **found}, seed=seed)
    return fitted.predict(rows, column), fitted, trials


def trials_table(df: DataFrame, trials: Sequence[Trial]) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(t.number, str(sorted(t.params.items(), key=lambda kv: kv[0])), t.state, len(t.running), float(t.running[-1])) for t in trials],
        "trial int, params string, state string, n_folds int, value double")


# ---- leaderboard ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Candidate:
    name: str
    model: str
    params: Mapping[str, Any] = field(default_factory=dict)


def candidate_predictions(train: DataFrame, valid: DataFrame, features: Sequence[Feature], target: str, id_col: str,
                          candidates: Sequence[Candidate], *, seed: int = 0) -> tuple[DataFrame, dict[str, FittedModel]]:
    """Stored predictions of every candidate, one column each, and the fitted models."""
    fitted = {c.name: fit_model(train, features, target, c.model, params=dict(c.params), seed=seed) for c in candidates}
    rows = valid
    for name, m in fitted.items():
        rows = m.predict(rows, f"p_{name}")
    table = rows.select(id_col, F.col(target).cast("double").alias("y"), *[f"p_{n}" for n in fitted])
    return cut_lineage(table), fitted


def out_of_fold_predictions(rows: DataFrame, features: Sequence[Feature], target: str, id_col: str, candidates: Sequence[Candidate], *,
                            split: SplitConfig = SplitConfig(), n_folds: int | None = None, parallelism: int = 1, seed: int = 0) -> DataFrame:
    """Each row predicted by candidates that were fitted without its fold: id, ``fold``, ``y`` and ``p_<candidate>``, stored.

    Rows without a target are left out; the warm-up rows of time windows have no predictions. Fits of different
    candidates and folds run side by side.
    """
    known = rows.filter(F.col(target).isNotNull())
    folded = cut_lineage(assign_folds(known, id_col, split, n_folds or split.outer_folds, name="fold"))
    last = folded.agg(F.max("fold")).first()[0]

    def one(at: tuple[int, Candidate]) -> tuple[int, str, FittedModel]:
        fold, c = at
        train, _ = train_test(folded, split, fold)
        folded.sparkSession.sparkContext.setLocalProperty("spark.scheduler.pool", f"{c.name}-fold-{fold}")
        return fold, c.name, fit_model(train, features, target, c.model, params=dict(c.params), seed=seed)

    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        fitted = {(f, n): m for f, n, m in pool.map(one, [(f, c) for f in range(1, last + 1) for c in candidates])}
    parts = []
    for fold in range(1, last + 1):
        _, part = train_test(folded, split, fold)
        for c in candidates:
            part = fitted[fold, c.name].predict(part, f"p_{c.name}")
        parts.append(part.select(id_col, "fold", F.col(target).cast("double").alias("y"), *[f"p_{c.name}" for c in candidates]))
    return cut_lineage(union_all(parts))


def stacking_weights(table: DataFrame, names: Sequence[str], *, fold_col: str | None = None) -> dict[Any, tuple[float, dict[str, float]]]:
    """The second level: the line in the candidates' predictions with the least squared error, as (intercept, weights).

    One aggregate gives all sums of products; the normal equations of that small matrix are solved on the driver,
    by the smallest weights where candidates agree. With ``fold_col`` there is a line for every fold, of all
    other folds' rows, so that a stacked prediction has not seen its own row either.
    """
    cols = [F.lit(1.0), *[F.col(f"p_{n}") for n in names], F.col("y")]
    sums = [F.sum(a * b).alias(f"g{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]
    parts = table.groupBy(*([fold_col] if fold_col else [])).agg(*sums).collect()
    m = len(cols)
    gram = {r[fold_col] if fold_col else None: np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)]) for r in parts}
    whole = sum(gram.values())
    out = {}
    for key in gram:
        g = whole - gram[key] if fold_col else whole
        w = np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=1e-12)[0]
        out[key] = float(w[0]), {n: float(v) for n, v in zip(names, w[1:])}
    return out


def stacked_prediction(table: DataFrame, weights: Mapping[Any, tuple[float, Mapping[str, float]]], column: str = "p_stacked", *, fold_col: str | None = None) -> DataFrame:
    """Add the second level's prediction; with ``fold_col`` each fold by its own line."""
    line = lambda at: sum((F.lit(w) * F.col(f"p_{n}") for n, w in weights[at][1].items()), F.lit(weights[at][0]))
    if fold_col is None:
        return table.withColumn(column, line(None))
    value = F.lit(None).cast("double")
    for fold in weights:
        value = F.when(F.col(fold_col) == fold, line(fold)).otherwise(value)
    return table.withColumn(column, value)


def stacked_leaderboard(table: DataFrame, names: Sequence[str], *, scoring: str = "neg_mean_squared_error", fold_col: str = "fold") -> DataFrame:
    """Candidates, their greedy average ("ensemble") and their second level ("stacked"), best first, all scored out of fold."""
    table = ensemble_prediction(table, ensemble_weights(table, names))
    table = stacked_prediction(table, stacking_weights(table, names, fold_col=fold_col), fold_col=fold_col)
    return leaderboard(cut_lineage(table), [*names, "ensemble", "stacked"], scoring=scoring)


def prediction_scores(table: DataFrame, names: Sequence[str], *, metrics: Sequence[str] = ("rmse",)) -> DataFrame:
    """Score per candidate of a wide prediction table, as ``pipeline`` plus metric columns."""
    pairs = F.array(*[F.struct(F.lit(n).alias("pipeline"), F.col(f"p_{n}").alias("p")) for n in names])
    return metric_table(table.select("y", F.inline(pairs)), "y", "p", metrics=metrics, by=["pipeline"])


def leaderboard(table: DataFrame, names: Sequence[str], *, scoring: str = "neg_mean_squared_error") -> DataFrame:
    """Candidates best first. Squared-error scoring adds a positive ``cv_rmse`` and sorts by it."""
    if scoring == "neg_mean_squared_error":
        s = prediction_scores(table, names, metrics=["mse", "rmse"])
        return s.select("pipeline", (-F.col("mse")).alias("cv_score"), F.col("rmse").alias("cv_rmse")).orderBy("cv_rmse", "pipeline")
    s = prediction_scores(table, names, metrics=[scoring]).select("pipeline", F.col(scoring).alias("cv_score"))
    return s.orderBy(F.col("cv_score").desc() if scoring in HIGHER_BETTER else F.col("cv_score").asc(), "pipeline")


def ensemble_weights(table: DataFrame, names: Sequence[str], *, rounds: int = 25) -> dict[str, float]:
    """Greedy ensemble selection with replacement (Caruana et al., 2004).

    The squared error of any average only needs the products of predictions and truth, so one aggregate
    over the rows is enough; the greedy rounds run on that small matrix.
    """
    cols = [f"p_{n}" for n in names]
    sums = [F.avg(F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]
    sums += [F.avg(F.col(a) * F.col("y")).alias(f"c{i}") for i, a in enumerate(cols)]
    row = table.agg(*sums).first()
    m = len(cols)
    gram = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)])
    cross = np.array([row[f"c{i}"] for i in range(m)])
    counts = np.zeros(m)
    best_counts, best_err = None, np.inf
    for _ in range(rounds):
        errs = []
        for i in range(m):
            w = counts.copy()
            w[i] += 1
            w /= w.sum()
            errs.append(w @ gram @ w - 2 * w @ cross)
        counts[int(np.argmin(errs))] += 1
        if min(errs) < best_err:
            best_counts, best_err = counts.copy(), min(errs)
    return {n: float(c / best_counts.sum()) for n, c in zip(names, best_counts)}


def ensemble_prediction(table: DataFrame, weights: Mapping[str, float], column: str = "p_ensemble") -> DataFrame:
    used = [F.col(f"p_{n}") * F.lit(w) for n, w in weights.items() if w > 0]
    return table.withColumn(column, sum(used[1:], used[0]))


def best_model_report(table: DataFrame, fitted: Mapping[str, FittedModel]) -> dict[str, Any]:
    """Name, parameters and the eight metrics of the best candidate; errors are positive."""
    best = leaderboard(table, list(fitted)).first()["pipeline"]
    m = fitted[best]
    row = prediction_scores(table, [best], metrics=REPORT).first()
    changed = {k: v for k, v in m.params.items() if DEFAULTS[m.model].get(k) != v}
    return {"best_model": best, "params": changed, "all_params": m.params, "info": {"model": m.model, "n_features": len(m.feature_names)},
            "metrics": {k: row[k] for k in REPORT}}
