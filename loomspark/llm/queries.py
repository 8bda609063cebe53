"""The registered queries of the ten operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import chat, decontaminate, language, media, minhash, packing, quality, repair, suffix, warc
from loomspark.llm.frames import table
from loomspark.llm.oracles import ORACLES  # noqa: F401


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Fixed values of the contract: the conversation that holds control strings.
CONTROL_CONVERSATION = "select * from values (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(CONTROL_CONVERSATION))
    read = chat.read_back(chat.windows(turns))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    parts = read.select("conv_id", F.struct("first_turn", said.alias("said"), F.col("loss_text").alias("loss")).alias("w"), F.size("turns").alias("n"), "chars")
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"), F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"), F.count("*").alias("n_windows"))
    loss = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return whole.select("conv_id", "n_turns", F.sha2(F.array_join(F.transform("w", lambda x: x["said"]), ""), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "n_windows")


def op2_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.inspect(media.encode_videos(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language.fit(docs.where(~held))
    return language.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "rejected")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = quality.fit_labels(docs, labels.where(~held))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.read_shards(repair.write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("word_bpe_49k.json")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_chat, op2_media_avi, op3_decontaminate, op4_suffix_dedup, op5_minhash, op6_language_id, op7_warc, op8_quality, op9_token_shards, op10_packing)}
