"""Regression models on MLlib: fit on training rows only, predict, save and load."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.feature import StandardScaler, StandardScalerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (
    GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel, RandomForestRegressionModel, RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propspark.plans.features import Feature, assemble, fill_numbers, fit_numbers
from propspark.plans.support import SupportLine, fit_support

MAX_DEPTH = 30  # MLlib's limit

# Defaults of each model. MLlib has no leaf penalties, no column sampling per tree and no
# trees without a depth limit, so those parameters do not exist here.
DEFAULTS: dict[str, dict[str, Any]] = {
    "rf": {"n_estimators": 500, "max_depth": MAX_DEPTH, "min_samples_leaf": 1, "max_features": 1.0, "bootstrap": True},
    "xgb": {"n_estimators": 2000, "learning_rate": 0.03, "max_depth": 6, "subsample": 0.8, "min_instances": 1},
    "lgbm": {"n_estimators": 5000, "learning_rate": 0.03, "max_depth": 6, "subsample": 0.8, "min_instances": 20},
    "svm": {"C": 10.0, "epsilon": 0.1, "gamma": "scale", "n_components": 256},
    "linear": {"reg_param": 0.0},
}
MODELS = tuple(DEFAULTS)
LOADERS = {"rf": RandomForestRegressionModel, "xgb": GBTRegressionModel, "lgbm": GBTRegressionModel,
           "svm": SupportLine, "linear": LinearRegressionModel}
METADATA = "best_model_metadata"


@dataclass(frozen=True)
class SupportVectors:
    """The kernel model's estimator: see ``fit_support``."""

    c: float
    epsilon: float
    tolerance: float = 1e-3

    def fit(self, rows: DataFrame) -> SupportLine:
        return fit_support(rows, c=self.c, epsilon=self.epsilon, tolerance=self.tolerance)


def make_estimator(model: str, params: dict[str, Any] | None = None, seed: int = 0):
    if model not in DEFAULTS:
        raise ValueError(f"unknown model: {model}")
    unknown = set(params or {}) - set(DEFAULTS[model])
    if unknown:
        raise ValueError(f"{model} has no parameters {sorted(unknown)}")
    p = {**DEFAULTS[model], **(params or {})}
    cols = dict(featuresCol="_features", labelCol="_label", predictionCol="_prediction")
    if "max_depth" in p and (p["max_depth"] is None or not 0 <= p["max_depth"] <= MAX_DEPTH):
        raise ValueError(f"max_depth must be from 0 to {MAX_DEPTH}, not {p['max_depth']}")
    if model == "rf":
        share = p["max_features"]
        subset = share if isinstance(share, str) else ("all" if share >= 1.0 else str(float(share)))
        return RandomForestRegressor(
            **cols, seed=seed, numTrees=int(p["n_estimators"]), maxDepth=int(p["max_depth"]), bootstrap=bool(p["bootstrap"]),
            minInstancesPerNode=int(p["min_samples_leaf"]), featureSubsetStrategy=subset)
    if model in ("xgb", "lgbm"):
        return GBTRegressor(
            **cols, seed=seed, maxIter=int(p["n_estimators"]), stepSize=float(p["learning_rate"]), maxDepth=int(p["max_depth"]),
            subsamplingRate=float(p["subsample"]), minInstancesPerNode=int(p["min_instances"]))
    if model == "svm":
        return SupportVectors(c=float(p["C"]), epsilon=float(p["epsilon"]))
    return LinearRegression(**cols, regParam=float(p["reg_param"]))


def fourier_features(c: Column, width: int, components: int, gamma: float, seed: int) -> Column:
    """Random Fourier features of an RBF kernel (Rahimi and Recht, 2007); the weights come from the seed."""
    rng = np.random.default_rng(seed)
    w = rng.normal(scale=np.sqrt(2.0 * gamma), size=(width, components))
    shift = rng.uniform(0.0, 2.0 * np.pi, components)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def apply(v: pd.Series) -> pd.Series:
        if v.empty:
            return pd.Series([], dtype=object)
        # At most 16 MB of inputs at a time, whatever the width.
        step = max(1, (1 << 21) // width)
        parts = [np.cos(np.stack(v.iloc[i : i + step].to_list()) @ w + shift) for i in range(0, len(v), step)]
        return pd.Series(list(np.sqrt(2.0 / components) * np.concatenate(parts)))

    return array_to_vector(apply(vector_to_array(c)))


@dataclass
class FittedModel:
    """Everything needed to score new rows."""

    model: str
    features: tuple[Feature, ...]
    target: str
    params: dict[str, Any]
    regressor: Any
    numbers: list[str] = field(default_factory=list)
    medians: dict[str, float] = field(default_factory=dict)
    scaler: StandardScalerModel | None = None
    fourier: dict[str, Any] | None = None

    @property
    def feature_names(self) -> list[str]:
        return [n for f in self.features for n in f.names if not f.numbers or n in set(self.numbers)]

    def _vectors(self, df: DataFrame) -> DataFrame:
        rows = assemble(fill_numbers(df, self.medians), self.features, self.numbers)
        return _scaled(rows, self.scaler, self.fourier)

    def predict(self, df: DataFrame, column: str = "prediction", *, label: str | None = None) -> DataFrame:
        """All input columns plus the prediction; narrow, no shuffle. A null ``label`` key gives null."""
        scored = self.regressor.transform(self._vectors(df))
        value = F.col("_prediction") if label is None else F.when(F.col(label).isNotNull(), F.col("_prediction"))
        return scored.select(*[F.col(f"`{c}`") for c in df.columns], value.alias(column))


def _scaled(df: DataFrame, scaler: StandardScalerModel | None, fourier: dict | None) -> DataFrame:
    if scaler is None:
        return df
    df = scaler.transform(df.withColumnRenamed("_features", "_raw")).drop("_raw")
    return df.withColumn("_features", fourier_features(F.col("_scaled"), **fourier)).drop("_scaled")


def fit_model(train: DataFrame, features: Sequence[Feature], target: str, model: str, *, params: dict | None = None, seed: int = 0) -> FittedModel:
    """Fit one model on featurised rows.

    Column pruning and medians come from the rows that have a target. Only the kernel model scales its inputs.
    """
    features = tuple(features)
    train = train.filter(F.col(target).isNotNull())
    estimator = make_estimator(model, params, seed)
    p = {**DEFAULTS[model], **(params or {})}
    numbers, medians = fit_numbers(train, features)
    rows = assemble(fill_numbers(train, medians), features, numbers)
    rows = rows.select("_features", F.col(target).cast("double").alias("_label"))
    scaler, fourier = None, None
    if model == "svm":
        width = sum(len(f.numbers and [c for c in f.numbers if c in set(numbers)]) or (0 if f.numbers else f.size) for f in features)
        # Inputs have unit variance, so "scale" and "auto" are the same here.
        gamma = 1.0 / width if p["gamma"] in ("scale", "auto") else float(p["gamma"])
        scaler = StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True).fit(rows.withColumnRenamed("_features", "_raw"))
        fourier = {"width": width, "components": int(p["n_components"]), "gamma": gamma, "seed": seed}
        rows = _scaled(rows, scaler, fourier)
    return FittedModel(model, features, target, p, estimator.fit(rows), numbers, medians, scaler, fourier)


def fit_predict(train: DataFrame, valid: DataFrame, features: Sequence[Feature], target: str, model: str, *, params: dict | None = None, seed: int = 0) -> tuple[DataFrame, FittedModel]:
    fitted = fit_model(train, features, target, model, params=params, seed=seed)
    return fitted.predict(valid), fitted


# ---- persistence ----------------------------------------------------------------------------------


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder on any file system Spark can reach."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(hadoop)] if fs.exists(hadoop) else []


def save_model(fitted: FittedModel, path: str, spark: SparkSession, *, feature_set: str = "", extra: dict | None = None) -> str:
    name = f"best_model_{fitted.model}"
    if isinstance(fitted.regressor, SupportLine):
        fitted.regressor.save(spark, f"{path}/{name}")
    else:
        fitted.regressor.write().overwrite().save(f"{path}/{name}")
    if fitted.scaler is not None:
        fitted.scaler.write().overwrite().save(f"{path}/scaler")
    meta = {
        "model": fitted.model, "feature_set": feature_set, "features": [asdict(f) for f in fitted.features], "target": fitted.target,
        "best_params": fitted.params, "feature_names": fitted.feature_names, "numbers": fitted.numbers,
        "medians": fitted.medians, "fourier": fitted.fourier, **(extra or {}),
    }
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{METADATA}")
    return path


def load_model(spark: SparkSession, path: str) -> tuple[FittedModel, dict]:
    names = _children(spark, path)
    if METADATA not in names:
        raise FileNotFoundError(f"missing metadata in {path}")
    saved = sorted(n for n in names if n.startswith("best_model_") and n != METADATA)
    if not saved:
        raise FileNotFoundError(f"no saved model in {path}")
    if len(saved) > 1:
        raise ValueError(f"expected exactly one saved model in {path}, found {len(saved)}")
    meta = json.loads(spark.read.text(f"{path}/{METADATA}").first()["value"])
    features = tuple(Feature(**{**f, "columns": tuple(f["columns"])}) for f in meta["features"])
    scaler = StandardScalerModel.load(f"{path}/scaler") if meta["fourier"] else None
    fitted = FittedModel(meta["model"], features, meta["target"], meta["best_params"], LOADERS[meta["model"]].load(f"{path}/{saved[0]}"),
                         meta["numbers"], meta["medians"], scaler, meta["fourier"])
    return fitted, meta
