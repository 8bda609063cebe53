"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.plans.shared import saved, ship

#: Rows of an Arrow batch: a batch of long texts must fit a worker's memory a few times.
BATCH_ROWS = 500
#: Ids that may be broadcast: 8 bytes each, so about 16 MB.
BROADCAST_IDS = 1_000_000
#: A key is hot if it has more than the HOT_PARTS-th part of all rows; so fewer than HOT_PARTS keys can be.
HOT_PARTS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow. Batches have BATCH_ROWS rows at most, also where a session has set a larger number itself; a session without a number of its own gets that one."""
    spark = df.sparkSession
    ship(spark)
    if "spark.sql.execution.arrow.maxRecordsPerBatch" not in spark.conf.getAll:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(b.slice(k, BATCH_ROWS) for b in batches for k in range(0, b.num_rows, BATCH_ROWS))

    return df.mapInArrow(run, schema)


def unique(df: DataFrame, id: str) -> bool:
    """Whether each row has an id of its own, an integer."""
    ids = df.select(F.col(id).cast("long").alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    return not ids.where("k is null or n > 1").limit(1).count()


def numbered(df: DataFrame, id: str, name: str) -> tuple[DataFrame, bool]:
    """df and name, which no two rows share and none lacks, in order of id; and whether it is the id.

    Where ids are null or repeated it is a number by id (null last), written, so that it stays.
    """
    if unique(df, id):
        return df.withColumn(name, F.col(id).cast("long")), True
    # rows of one id, or without any, are dealt over the tasks by a number of their own
    order = F.col(id).asc_nulls_last(), F.col("__nth").asc()
    rows = df.withColumn("__nth", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return saved(rows.drop("__nth").withColumn(name, F.monotonically_increasing_id()), "numbered"), False


def only(df: DataFrame, ids: DataFrame, key: str, count: int | None = None) -> DataFrame:
    """Rows of df whose key is in ids (distinct): by broadcast if they are few enough, counted first, else by a shuffled join."""
    count = ids.count() if count is None else count
    return df.join(F.broadcast(ids) if count <= BROADCAST_IDS else ids, key, "left_semi")


def spread_join(left: DataFrame, counts: DataFrame, keys: list[str], rows: int, how: str = "inner") -> DataFrame:
    """left joined with counts (keys, unique, and n: about how often left has each; not null), for any skew.

    Hot keys, of which there are fewer than HOT_PARTS whatever the data, meet left by broadcast; the rows of other keys,
    none of which has more than that part of rows, by a shuffle. rows: the sum of n over all keys at most.
    """
    hot = F.col("n") > rows / HOT_PARTS
    met = left.join(F.broadcast(counts.where(hot)), keys, "left")
    extra = [c for c in counts.columns if c not in keys]
    return met.where("n is not null").unionByName(met.where("n is null").drop(*extra).join(counts.where(~hot), keys, how))
