"""The corpus pipeline: quality, exact copies, near copies, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.llm import exact_dedup, mixing, packing, quality, simhash
from siltwork.llm.common import discard, free_name, materialised, table
from siltwork.session import spread


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels of docs outside the held-out quarter."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "quality_score_")
    return quality.scored(spread(docs), model, score_column=score).filter(F.col(score) >= quality.THRESHOLD).select(docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of 0.8 or more similarity between five-word shingles stays."""
    return simhash.near_dedup(spread(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a source's last one is cut where its budget ends."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = packing.best_fit_pack(spread(docs), "word", public_tokenizers.path("word_bpe_49k.json"), 0)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]

ORACLE_SQL = None  # a learned classifier and SimHash can't be said in SQL; tests compare stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialised(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
