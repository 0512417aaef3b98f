"""Regression on time-series features with Spark ML, and choice by time-ordered folds."""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from tillwork.operators.series import feature_names, holdout_split, time_series_split
from tillwork.sources.scratch import materialise

SEED = 42
MODEL_NAMES = ("random_forest", "gradient_boosting", "linear_regression")


def assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=feature_names(), outputCol="features")


def estimator(name: str, seed: int = SEED, **params) -> Pipeline:
    """An unfitted pipeline from feature columns to ``prediction``."""
    stages: list[Estimator] = [assembler()]
    if name == "random_forest":
        settings = {"numTrees": 100, "featureSubsetStrategy": "all", "maxDepth": 15, **params}
        stages.append(RandomForestRegressor(labelCol="y", seed=seed, **settings))
    elif name == "gradient_boosting":
        settings = {"maxIter": 100, "maxDepth": 3, "stepSize": 0.1, **params}
        stages.append(GBTRegressor(labelCol="y", seed=seed, **settings))
    elif name == "linear_regression":
        stages.append(StandardScaler(inputCol="features", outputCol="scaled", withMean=True))
        stages.append(LinearRegression(labelCol="y", featuresCol="scaled", **params))
    else:
        raise ValueError(f"unknown model {name}")
    return Pipeline(stages=stages)


def fit_and_predict(features: DataFrame, name: str, test_size: float = 0.2, **params) -> DataFrame:
    """Train on the first part of each series, predict the rest."""
    split = materialise(holdout_split(features, test_size), "features")
    model = estimator(name, **params).fit(split.where("role = 'train'"))
    return model.transform(split.where("role = 'test'")).select("series_id", "t", "y", "prediction")


@dataclass(frozen=True)
class Selection:
    """The outcome of ``model_selection``."""

    scores: DataFrame
    best: str
    model: PipelineModel


def model_selection(
    features: DataFrame,
    folds: int = 3,
    names: tuple[str, ...] = MODEL_NAMES,
    params: dict[str, dict] | None = None,
    parallelism: int = 8,
) -> Selection:
    """Mean absolute error per model over time-ordered folds; the best is refitted on all rows.

    The refitted model is a whole pipeline, scaling included. Up to
    ``parallelism`` fits are submitted to Spark at the same time.
    """
    params = params or {}
    # The fits read the rows many times, so write them once.
    features = materialise(features, "features")
    split = materialise(time_series_split(features, folds), "folds")
    evaluator = RegressionEvaluator(labelCol="y", metricName="mae")

    def score(task: tuple[str, int]) -> tuple[str, int, float]:
        name, fold = task
        rows_of = split.where(F.col("fold") == fold)
        model = estimator(name, **params.get(name, {})).fit(rows_of.where("role = 'train'"))
        return name, fold, float(evaluator.evaluate(model.transform(rows_of.where("role = 'test'"))))

    tasks = [(name, fold) for name in names for fold in range(folds)]
    with ThreadPool(min(parallelism, len(tasks))) as pool:
        rows = pool.map(inheritable_thread_target(features.sparkSession)(score), tasks)
    by_fold = features.sparkSession.createDataFrame(rows, "model STRING, fold BIGINT, mae DOUBLE")
    scores = by_fold.groupBy("model").agg(F.avg("mae").alias("mae"))
    means = {name: sum(r[2] for r in rows if r[0] == name) / folds for name in names}
    best = min(means, key=means.get)
    model = estimator(best, **params.get(best, {})).fit(features)
    return Selection(scores.withColumn("is_best", F.col("model") == best), best, model)
