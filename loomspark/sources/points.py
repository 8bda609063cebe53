"""Points in and out: frames of (point_id BIGINT from 1, coords ARRAY<DOUBLE>)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATOR = ","


def points(df: DataFrame, coords: str | list[str], id: str | None = None, mode: str = "fail") -> DataFrame:
    """Points out of numeric columns, or of one array or vector column.

    id: a column with unique integers from 1; without it ids are made, and depend on the layout of df.
    mode: "fail" raises when a row with a null, NaN or infinite coordinate or id is read, "drop" leaves it out.
    """
    if mode not in ("fail", "drop"):
        raise ValueError("mode is fail or drop")
    if isinstance(coords, str):
        if df.schema[coords].dataType.typeName() == "vectorudt":
            from pyspark.ml.functions import vector_to_array

            c = vector_to_array(F.col(coords))
        else:
            c = F.col(coords).cast("array<double>")
    else:
        c = F.array(*[F.col(x).cast("double") for x in coords])
    key = F.col(id).cast("long") if id else F.monotonically_increasing_id() + 1
    rows = df.select(key.alias("point_id"), F.transform(c, lambda x: x + 0.0).alias("coords"))  # -0.0 becomes 0.0
    bad = F.col("coords").isNull() | F.exists("coords", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | F.col("point_id").isNull() | (F.col("point_id") < 1)
    bad = F.coalesce(bad, F.lit(True))
    if mode == "drop":
        return rows.where(~bad)
    said = F.raise_error(F.concat(F.lit("not a point (a null, NaN or infinite value, or an id below 1): "), F.coalesce(F.to_json(F.struct("point_id", "coords")), F.lit("null"))))
    return rows.withColumn("coords", F.when(bad, said.cast("array<double>")).otherwise(F.col("coords")))


def read_csv(spark: SparkSession, path: str, mode: str = "fail") -> DataFrame:
    """Header-less text, a point a line, of any dimensionality; ids are made. Blank lines and texts that are no number are bad rows."""
    parts = F.split("value", SEPARATOR)
    rows = spark.read.text(path).select(F.transform(parts, lambda x: F.trim(x).try_cast("double")).alias("c"))
    return points(rows, "c", mode=mode)


def write_csv(labelled: DataFrame, path: str) -> None:
    """coord1,...,coordN,cluster_id lines; fails if path exists."""
    labelled.select(F.concat_ws(SEPARATOR, F.transform("coords", lambda x: x.cast("string")), F.col("cluster_id").cast("string"))).write.mode("errorifexists").text(path)


@dataclass(frozen=True)
class Profile:
    """Rows, and each coordinate's variance, least and largest value."""

    rows: int
    variance: tuple[float, ...] = ()
    lower: tuple[float, ...] = ()
    upper: tuple[float, ...] = ()

    @property
    def dims(self) -> int:
        return len(self.variance)


def profile(df: DataFrame) -> Profile:
    """In one aggregation, once the first row has said how many coordinates there are. Rows of different lengths are an error."""
    first = df.select(F.size("coords").alias("n")).head(1)
    if not first:
        return Profile(0)
    n = first[0]["n"]
    each = [f(F.get("coords", F.lit(i))).alias(f"{f.__name__}{i}") for f in (F.var_pop, F.min, F.max) for i in range(n)]
    row = df.agg(F.count("*").alias("rows"), F.min(F.size("coords")).alias("lo"), F.max(F.size("coords")).alias("hi"), *each).first()
    if row["lo"] != row["hi"] or not row["hi"]:
        raise ValueError(f"points have from {row['lo']} to {row['hi']} coordinates")
    values = [float(x) for x in row[3:]]
    return Profile(row["rows"], tuple(values[:n]), tuple(values[n : 2 * n]), tuple(values[2 * n :]))
