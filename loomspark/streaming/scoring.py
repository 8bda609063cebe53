"""Labels for a stream of points under a fitted model: every micro-batch is a batch prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loomspark.plans.model import DensityModel


def score_stream(model: DensityModel, stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write (point_id, cluster_id) of each micro-batch of stream (point_id, coords) to path, a folder by batch, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        model.predict(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
