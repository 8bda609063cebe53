"""Documents from raw to packed: quality, near duplicates, repeated passages, benchmark passages, sequences.

Each stage takes the documents that the one before kept and returns them in the columns of `documents`, the last one
the pieces with their sequences. Nulls, empty and very long texts, repeated rows and empty tables have the results that
the operators define; documents with a null or a repeated id are documents like others, and of identical rows one goes on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import decontaminate, minhash, packing, quality, suffix
from loomspark.llm.frames import numbered, table, unique
from loomspark.llm.queries import vocabulary
from loomspark.plans.shared import saved

QUALITY_THRESHOLD = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least QUALITY_THRESHOLD; the classifier learns from the labelled ones among them."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit_labels(docs, labels)
    own = docs.select(F.struct("*").alias("own"), "text")
    return quality.score(own, model, keep=["own"]).where(F.col("quality_score") >= QUALITY_THRESHOLD).select("own.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id (null: the largest) of each group of near duplicates, and one of identical rows."""
    if not unique(docs, "doc_id"):
        docs = saved(docs.distinct(), "distinct")
    rows, _ = numbered(docs, "doc_id", "__row")
    gone = minhash.near_duplicates(rows, id="__row").where("not kept").select(F.col("doc_id").alias("__row"))
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that repeated strings of suffix.PASSAGE bytes cover; n_chars follows the text."""
    kept = suffix.remove_repeats(docs, length=suffix.PASSAGE, with_text=True, keep=docs.drop("text").columns)
    out = kept.select("own.*", F.col("kept_text").alias("text"))
    return _with_length(out).select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly such passages go."""
    rows, _ = numbered(docs, "doc_id", "__row")
    out = decontaminate.remove(rows, table(spark, sf_dir, "benchmark"), id="__row")
    return _with_length(out).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and its place there."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", repeated_passage_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]

#: SQL can't express the classifier, the components or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
