"""Ranking models as stages of a spark.ml pipeline."""

from __future__ import annotations

import json
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasPredictionCol
from pyspark.ml.regression import (
    GBTRegressionModel,
    GBTRegressor,
    LinearRegression,
    LinearRegressionModel,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.chains import on_chain
from ..functions.groups import durable, stored
from .cross_section import clean, relevance_labels
from .joins import asof_join
from .labels import calendar

FITTED = {"linear": LinearRegressionModel, "random_forest": RandomForestRegressionModel, "gradient_boosting": GBTRegressionModel}
MODELS = tuple(FITTED)


class CrossSectionCleaner(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Per-date cleaning of the input columns: finite, sigma clip, median."""

    sigma = Param(Params._dummy(), "sigma", "deviations kept on either side of the mean of a date", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, sigma: float = 3.0):  # noqa: N803
        super().__init__()
        self._setDefault(sigma=3.0)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return clean(dataset, self.getInputCols(), self.getOrDefault(self.sigma))


class _RankingParams(HasInputCols, HasLabelCol, HasPredictionCol):
    algorithm = Param(Params._dummy(), "algorithm", f"one of {', '.join(MODELS)}", TypeConverters.toString)
    settings = Param(Params._dummy(), "settings", "parameters of the algorithm, as JSON", TypeConverters.toString)


class RankingEstimator(Estimator, _RankingParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits a cross-sectional model on rows with every feature and the label (ML1-ML4).

    Gradient boosting learns the per-date relevance scaled to [0, 1] in place of a pairwise
    ranking loss.
    """

    @keyword_only
    def __init__(
        self, *, inputCols: list[str] | None = None, labelCol: str = "label", algorithm: str = "random_forest",  # noqa: N803
        settings: str = "{}", predictionCol: str = "prediction",  # noqa: N803
    ):
        super().__init__()
        self._setDefault(labelCol="label", algorithm="random_forest", settings="{}", predictionCol="prediction")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> RankingModel:
        features, label, name = self.getInputCols(), self.getLabelCol(), self.getOrDefault(self.algorithm)
        if name not in FITTED:
            raise ValueError(f"no ranking model is called {name}; there are {', '.join(MODELS)}")
        frame = dataset.dropna(subset=[*features, label])
        if name == "gradient_boosting":
            ranked = relevance_labels(frame, label)
            scaled = F.col("relevance") / F.greatest(F.col("group_size") - 1, F.lit(1))
            frame, label = ranked.withColumn("_relevance", scaled), "_relevance"
        frame = durable(frame.select("date", *features, label))
        facts = frame.agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("date").alias("d"), F.stddev_pop(label).alias("s")
        ).first()
        if facts["n"] == 0 or facts["d"] < 2:
            raise ValueError("complete rows on two dates are the least a ranking model learns from")
        vectors = VectorAssembler(inputCols=features, outputCol="_features").transform(frame)
        settings = json.loads(self.getOrDefault(self.settings))
        inner = _learner(name, facts["n"], facts["s"], label, **settings).fit(vectors)
        return self._copyValues(RankingModel(inner=inner))


class _RankingModelWriter(MLWriter):
    def __init__(self, model: RankingModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.inner.write().save(f"{path}/inner")


class _RankingModelReader(MLReader):
    def load(self, path: str) -> RankingModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = RankingModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.inner = FITTED[model.getOrDefault(model.algorithm)].load(f"{path}/inner")
        return model


class RankingModel(Model, _RankingParams, MLReadable, MLWritable):
    """Adds the prediction; rows with a missing feature keep NULL (ML4)."""

    def __init__(self, inner: Model | None = None):
        super().__init__()
        self.inner = inner

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = self.getPredictionCol()
        ready = F.lit(True)
        for f in self.getInputCols():
            ready = ready & F.col(f).isNotNull()
        vectors = VectorAssembler(inputCols=self.getInputCols(), outputCol="_features", handleInvalid="keep")
        scored = self.inner.transform(vectors.transform(dataset))
        return scored.withColumn(out, F.when(ready, F.col("_prediction"))).select(*dataset.columns, out)

    def write(self) -> MLWriter:
        return _RankingModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _RankingModelReader()


def _learner(name: str, rows: int, spread: float, label: str, seed: int = 0, **params):
    common = {"featuresCol": "_features", "labelCol": label, "predictionCol": "_prediction"}
    if name == "linear":
        # The ridge penalty acts on a sum of squares; Spark averages the error over the
        # rows and divides the label by its deviation first.
        alpha = params.pop("alpha", 1.0)
        return LinearRegression(
            regParam=alpha * spread / rows, elasticNetParam=0.0, standardization=False, solver="normal", **common, **params
        )
    if name == "random_forest":
        return RandomForestRegressor(**{"numTrees": 100, "seed": seed, **common, **params})
    return GBTRegressor(**{"maxIter": 100, "seed": seed, **common, **params})


def ranking_pipeline(features: Sequence[str], label: str, name: str = "random_forest", cleaned: bool = False, **params) -> Pipeline:
    """Cleaning, unless the data has been cleaned per date already, and a ranking model."""
    first = [] if cleaned else [CrossSectionCleaner(inputCols=list(features))]
    return Pipeline(stages=[*first, RankingEstimator(inputCols=list(features), labelCol=label, algorithm=name, settings=json.dumps(params))])


def fit_ranking(data: DataFrame, features: Sequence[str], label: str, name: str = "random_forest", cleaned: bool = False, **params) -> PipelineModel:
    """A fitted ``ranking_pipeline``; it predicts with ``transform``."""
    return ranking_pipeline(features, label, name, cleaned, **params).fit(data)


def feature_importance(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """Tree importance, or absolute coefficients (ML5)."""
    last = model.stages[-1]
    values = (
        [abs(float(c)) for c in last.inner.coefficients]
        if last.getOrDefault(last.algorithm) == "linear"
        else [float(v) for v in last.inner.featureImportances.toArray()]
    )
    return spark.createDataFrame(list(zip(last.getInputCols(), values, strict=True)), "feature string, importance double")


# ---------------------------------------------------------------- refits over time

# The least that a refit learns from.
LEAST_DATES, LEAST_ROWS, ROWS_A_FEATURE = 20, 100, 10


def refit_table(panel: DataFrame, complete: Sequence[str], every: int, horizon: int, train_window: int, retrain: int, least: int) -> DataFrame:
    """``idx, first, last, usable``: the sessions at which a model is refitted, or given up (ML6).

    Training windows and their sizes are frames over the calendar. Each rebalance session
    names the session of the next refit if it were one itself: ``retrain`` sessions on, or the
    next rebalance where its window is too thin. The refits are the chain from the first one.
    """
    sizes = panel.dropna(subset=list(complete)).groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    cal = calendar(panel).join(sizes, "date", "left")
    frame = Window.orderBy("idx").rowsBetween(-(train_window - 1), 0)
    spans = cal.select(
        (F.col("idx") + horizon).alias("idx"), F.min("date").over(frame).alias("first"), F.col("date").alias("last"),
        ((F.count("n").over(frame) >= LEAST_DATES) & (F.coalesce(F.sum("n").over(frame), F.lit(0)) >= least)).alias("usable"),
    )
    last = cal.agg(F.max("idx").alias("_end"))
    turns = spans.join(cal.select("idx"), "idx").join(F.broadcast(last)).filter((F.col("idx") % every == 0) & (F.col("idx") < F.col("_end")))
    step = F.when(F.col("usable"), F.ceil((F.col("idx") + retrain) / every) * every).otherwise(F.col("idx") + every)
    turns = durable(turns.select(F.lit(0).alias("one"), F.col("idx").cast("long").alias("idx"), "first", "last", "usable", step.cast("long").alias("after")))
    return turns.join(on_chain(turns, ["one"], "idx", "after"), ["one", "idx"]).drop("one", "after")


def rolling_refit_scores(
    panel: DataFrame,
    features: Sequence[str],
    label: str,
    every: int = 20,
    horizon: int = 20,
    train_window: int = 252,
    retrain: int = 60,
    name: str = "random_forest",
    **params,
) -> tuple[DataFrame, DataFrame]:
    """Scores on each rebalance date from models refitted on matured dates (ML6).

    Returns ``date, code, prediction`` and the importances per refit. The panel has been
    cleaned per date already. Refits are rows of a calendar table; their fits do not depend on
    one another and run side by side, each over the stored panel.
    """
    spark = panel.sparkSession
    frame = stored(panel.select("date", "code", *features, label))
    least = max(LEAST_ROWS, ROWS_A_FEATURE * len(features))
    refits = durable(refit_table(frame, [*features, label], every, horizon, train_window, retrain, least))
    turns = calendar(frame).filter(F.col("idx") % every == 0)
    shown = refits.select(F.col("idx").alias("_at"), "idx", "usable").withColumnRenamed("idx", "model")
    # The refit in force; a thin window leaves none until the next.
    held = durable(asof_join(turns, shown, [], "idx", "_at", ["model", "usable"]).filter("usable").select("date", "model"))
    last = calendar(frame).agg(F.max("date").alias("date"))
    held = held.join(F.broadcast(last), "date", "left_anti")

    def run(row) -> tuple[DataFrame, DataFrame]:
        model = fit_ranking(frame.filter(F.col("date").between(row["first"], row["last"])), features, label, name, cleaned=True, **params)
        days = held.filter(F.col("model") == row["idx"]).select("date")
        current = frame.dropna(subset=list(features)).join(F.broadcast(days), "date", "left_semi")
        return model.transform(current).select("date", "code", "prediction"), feature_importance(model, spark)

    rows = refits.filter("usable").orderBy("idx").collect()  # a row per refit
    with ThreadPool(4) as pool:
        done = pool.map(run, rows)
    scores = spark.createDataFrame([], "date date, code string, prediction double")
    importances = spark.createDataFrame([], "feature string, importance double")
    for scored, importance in done:
        scores, importances = scores.unionByName(scored), importances.unionByName(importance)
    return scores, importances
