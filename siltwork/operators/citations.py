"""Citations of generated answers against the rows that were retrieved for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cited_files, cited_numbers, strip_sources


def structured_citations(answers: DataFrame, retrieved: DataFrame, key: str, answer: str) -> DataFrame:
    """answers(key, answer) and retrieved(key, rank, source, page, modality) as (key, source, page, modality, pos).

    A block of sources that the answer brings itself isn't read. [n] is the retrieved row of that rank; numbers without a row say
    nothing. Behind these come [file:page] and [file:image], the older form, whose modality is that of the file's
    first retrieved row, or text. A file, page and modality counts once, where it comes first.
    """
    body = answers.select(key, strip_sources(F.col(answer)).alias("body"))
    rows = retrieved.select(key, "rank", "source", "page", "modality")
    numbered = body.select(key, F.posexplode(cited_numbers(F.col("body"))).alias("at", "rank")).join(rows, [key, "rank"])
    numbered = numbered.select(key, F.struct(F.lit(1).alias("form"), "at").alias("place"), "source", "page", "modality")
    known = rows.groupBy(key, "source").agg(F.min_by("modality", "rank").alias("known"))
    older = body.select(key, F.posexplode(cited_files(F.col("body"))).alias("at", "f")).select(key, "at", F.col("f.file").alias("source"), "f.page").join(known, [key, "source"], "left")
    modality = F.when(F.col("page").isNull(), "image").otherwise(F.coalesce("known", F.lit("text")))
    older = older.select(key, F.struct(F.lit(2).alias("form"), "at").alias("place"), "source", F.coalesce("page", F.lit(0)).alias("page"), modality.alias("modality"))
    once = numbered.union(older).groupBy(key, "source", "page", "modality").agg(F.min("place").alias("place"))
    return once.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("place")).cast("long")).drop("place")
