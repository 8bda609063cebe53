"""Tables in the folder that driver and executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder, set as such, only where it is unset (tests)."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="loomspark-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """df, written once as Parquet in the shared folder and read from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loom-{uuid.uuid4().hex[:12]}-{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path
    for scope in _scopes[-1:]:
        scope.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that saved() returned and that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_loom_path", None)
        if path:
            jvm = t.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Tables that are saved inside are deleted at the end: use results, or write them, before it."""
    _scopes.append([])
    try:
        yield
    finally:
        discard(*_scopes.pop())


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once for each context, whatever their PYTHONPATH. The file goes to them through Spark."""
    context = spark.sparkContext
    if getattr(context, "_loomspark_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    path = f"{tempfile.mkdtemp()}/loomspark_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((root / "loomspark").rglob("*.py")):
            z.write(p, p.relative_to(root))
    context.addPyFile(path)
    context._loomspark_shipped = True
