"""One thin query for each llm operator, over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from . import chat_format, conversation_repair, exact_dedup, kneser_ney, mixing, mpeg_audio, packing, quality, simhash, url_filter, vector_codes, warc
from .common import table
from .oracles import ORACLES


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = mpeg_audio.stored(texts(spark, sf_dir))
    names = "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature samples sample_rate frame_offsets"
    return facts.select(*names.split())


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_archive(table(spark, sf_dir, "pages"))
    records = warc.read_archive(spark, folder)
    return records.withColumns({c: F.col(c).try_cast("long") for c in ("page_id", "refers_to")})


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.formatted(conversations.unionByName(extra))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.linked(texts(spark, sf_dir))


def op6_token_matrices(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Byte-level ids, id 50256 after each document; it also pads."""
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.packed_matrices(texts(spark, sf_dir), "byte", path, 50256, 50256, pattern=public_tokenizers.PATTERN)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    packed = packing.best_fit_pack(texts(spark, sf_dir), "word", path, 0)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scores = quality.scored(texts(spark, sf_dir), model).drop("text")
    return scores.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(documents).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = texts(spark, sf_dir)
    scores = kneser_ney.scored(documents, kneser_ney.fit(documents))
    return scores.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired(table(spark, sf_dir, "conversations"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_mpeg_audio, op2_warc, op3_url_filter, op4_chat_format, op5_simhash, op6_token_matrices, op7_best_fit_packing, op8_quality, op9_mixing, op10_exact_dedup, op11_kneser_ney, op12_conversation_repair, op13_vector_codes)}
ORACLE_SQL = ORACLES
