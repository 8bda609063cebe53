"""Fitting, and the fitted model."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import boxes as bx
from loomspark.operators import labels
from loomspark.plans.shared import saved
from loomspark.settings import BoxSettings, ClusterSettings
from loomspark.sources.points import write_csv


class DensityModel:
    """Labelled points and their settings."""

    def __init__(self, labelled: DataFrame, settings: ClusterSettings):
        self.labelled, self.settings = labelled, settings

    def predict(self, queries: DataFrame) -> DataFrame:
        return labels.predict(self.labelled, queries, self.settings)

    def predict_point(self, *coords: float) -> int:
        one = self.labelled.sparkSession.createDataFrame([(1, [float(x) for x in coords])], "point_id long, coords array<double>")
        return self.predict(one).first()["cluster_id"]

    def noise_points(self) -> DataFrame:
        return labels.noise_points(self.labelled)

    def clustered_points(self) -> DataFrame:
        return labels.clustered_points(self.labelled)

    def summary(self) -> DataFrame:
        return labels.summary(self.labelled)

    def save_csv(self, path: str) -> None:
        write_csv(self.labelled, path)

    def save(self, path: str) -> None:
        self.labelled.write.parquet(f"{path}/labelled")
        self.labelled.sparkSession.createDataFrame([(float(self.settings.eps), *list(asdict(self.settings).values())[1:])], "eps double, min_points int, metric string, border_as_noise boolean").write.parquet(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> DensityModel:
        row = spark.read.parquet(f"{path}/settings").first()
        return DensityModel(spark.read.parquet(f"{path}/labelled"), ClusterSettings(**row.asDict()))


class DensityClusterer:
    """DensityClusterer(eps=..., min_points=...).fit(points).

    debug: a folder, or a function of a name and a frame, for what a run is made of: boxes, placed (points with their
    box and partition), partial, mappings, near_bounds (points near a box's bounds, with their label) and summary.
    """

    def __init__(self, settings: ClusterSettings | None = None, boxes: BoxSettings = BoxSettings(), debug: str | Callable[[str, DataFrame], None] | None = None, **given):
        self.settings, self.boxes = settings or ClusterSettings(**given), boxes
        self.show = (lambda name, df: df.write.parquet(f"{debug}/{name}")) if isinstance(debug, str) else debug

    def fit(self, points: DataFrame) -> DensityModel:
        """points: point_id and coords, as loomspark.sources.points makes them. Ids that were made by a layout are fixed by writing them first."""
        points = saved(points.select(F.col("point_id").cast("long"), F.col("coords").cast("array<double>").alias("coords")), "points")
        model = DensityModel(saved(labels.label(points, self.settings, self.show), "labelled"), self.settings)
        if self.show:
            self._debug(points, model)
        return model

    def _debug(self, points: DataFrame, model: DensityModel) -> None:
        eps = self.settings.eps
        boxes = bx.density_boxes(points, eps, self.boxes)
        placed = bx.partition_by_box(bx.assign(points, boxes, eps, self.boxes)).withColumn("partition", F.spark_partition_id())
        near = bx.near_bounds(placed, eps).select("point_id", "coords", "path")
        self.show("boxes", boxes)
        self.show("placed", placed.select("point_id", "coords", "path", "partition"))
        self.show("near_bounds", near.join(model.labelled.select("point_id", "cluster_id"), "point_id"))
        self.show("summary", model.summary())
