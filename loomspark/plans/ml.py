"""The clustering as a pyspark.ml Estimator and Model, for pipelines and saved stages."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReader, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators import labels
from loomspark.plans.model import DensityClusterer
from loomspark.settings import ClusterSettings
from loomspark.sources.points import points


class _Settings(Params):
    eps = Param(Params._dummy(), "eps", "radius, inclusive", TypeConverters.toFloat)
    minPoints = Param(Params._dummy(), "minPoints", "neighbours that make a core point, itself included", TypeConverters.toInt)
    metric = Param(Params._dummy(), "metric", "name of a registered metric", TypeConverters.toString)
    borderAsNoise = Param(Params._dummy(), "borderAsNoise", "border points are noise", TypeConverters.toBoolean)
    featuresCol = Param(Params._dummy(), "featuresCol", "a vector, or an array of numbers", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "unique integers from 1", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "cluster: 0 noise, -1 a new one", TypeConverters.toString)

    def settings(self) -> ClusterSettings:
        return ClusterSettings(*(self.getOrDefault(p) for p in (self.eps, self.minPoints, self.metric, self.borderAsNoise)))

    def _points(self, df: DataFrame) -> DataFrame:
        return points(df, self.getOrDefault(self.featuresCol), self.getOrDefault(self.idCol))


class DensityClustering(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """fit(df) clusters the rows of df; its model predicts others."""

    @keyword_only
    def __init__(self, *, eps: float = 1e-4, minPoints: int = 3, metric: str = "euclidean", borderAsNoise: bool = False, featuresCol: str = "features", idCol: str = "id", predictionCol: str = "prediction"):
        super().__init__()
        self._setDefault(eps=1e-4, minPoints=3, metric="euclidean", borderAsNoise=False, featuresCol="features", idCol="id", predictionCol="prediction")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> DensityClusteringModel:
        model = DensityClusteringModel(DensityClusterer(self.settings()).fit(self._points(dataset)).labelled)
        return self._copyValues(model)


class DensityClusteringModel(Model, _Settings):
    """labelled: the fitted rows. transform(df) adds predictionCol by the vote of their neighbours among them."""

    def __init__(self, labelled: DataFrame | None = None):
        super().__init__()
        self._setDefault(eps=1e-4, minPoints=3, metric="euclidean", borderAsNoise=False, featuresCol="features", idCol="id", predictionCol="prediction")
        self.labelled = labelled

    def _transform(self, dataset: DataFrame) -> DataFrame:
        found = labels.predict(self.labelled, self._points(dataset), self.settings())
        id, out = self.getOrDefault(self.idCol), self.getOrDefault(self.predictionCol)
        found = found.select(F.col("point_id").alias("__id"), F.col("cluster_id").alias(out))
        return dataset.join(found, F.col(id).cast("long") == F.col("__id"), "left").drop("__id")

    def write(self) -> MLWriter:
        return _Writer(self)

    def save(self, path: str) -> None:
        self.write().save(path)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()

    @classmethod
    def load(cls, path: str) -> DensityClusteringModel:
        return cls.read().load(path)


class _Writer(MLWriter):
    def __init__(self, model: DensityClusteringModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.labelled.write.parquet(f"{path}/labelled")


class _Reader(MLReader):
    def load(self, path: str) -> DensityClusteringModel:
        about = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = DensityClusteringModel(self.sparkSession.read.parquet(f"{path}/labelled"))
        model._resetUid(about["uid"])
        DefaultParamsReader.getAndSetParams(model, about)
        return model
