"""Exact deduplication by sorting content.

Sampled splitters (Spark's range partitioner) deal the rows out by the leading bytes of the normalised
text; each partition sorts by the whole normalised text, so equal texts become neighbours, and the window
operator compares neighbours in full. Only copies of heavy texts, below, are told by a digest.

A text that holds a large share of the rows would fill one partition, and so would many texts with the
same opening. A sample of DRAWN rows for each partition names such openings and texts: one of an eighth of a
partition's rows is drawn HEAVY times on average, and there are never more than 8 of each for each
partition, which bounds what is broadcast. Rows under a heavy opening are salted by their content, and copies of a
heavy text, known by its SHA-256, by all their columns, over as many parts as there are partitions; the keeper of a
heavy text comes from an aggregation over its digest, which combines copies before the shuffle. All other
texts are compared in full. The sample only steers the layout: results don't depend on it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE_SPACE, free_name, materialised, need, text_or_empty

HEAVY = 50  # drawn rows from which an opening or text counts as heavy
DRAWN = 8 * HEAVY  # rows drawn for each partition
LEAST = 50  # partitions that the sample counts with at least
OPENING = 64  # characters of the normalised text that range partitioning sees


def normalised(text: Column) -> Column:
    """Each run of white space replaced by one space."""
    return F.regexp_replace(text, f"[{WHITE_SPACE}]+", " ")


def opening(text: Column) -> Column:
    """The first OPENING characters of the normalised text, mostly without normalising all of it."""
    head = normalised(F.substring(text, 1, 4 * OPENING))
    cut = F.when(
        (F.length(head) <= OPENING) & (F.length(text) > 4 * OPENING), normalised(text)
    ).otherwise(head)
    return F.substring(cut, 1, OPENING)


def _heavy(df: DataFrame, text: Column, parts: int) -> DataFrame:
    """(kind, value): openings, kind o, and digests of texts, kind d, of many rows; at most 2 * DRAWN / HEAVY * parts rows."""
    rows = df.count()
    drawn = df.select(text.alias("t")).sample(False, min(1.0, DRAWN * parts / max(1, rows)), seed=7)
    drawn = drawn.select(opening(F.col("t")).alias("o"), F.sha2(normalised(F.col("t")), 256).alias("d"))
    found = drawn.select(F.explode(F.create_map(F.lit("o"), "o", F.lit("d"), "d")).alias("kind", "value")).groupBy("kind", "value").count()
    return materialised(found.filter(F.col("count") >= HEAVY).select("kind", "value"), "heavy")


def exact_dedup(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row of df with keep_id, group_size, kept and text_sha256.

    Texts are equal if they are identical once each run of white space is one space; a null text counts
    as empty. Of equal texts the row with the smallest id stays; a null id is larger than any other, and
    of repeated rows with that id exactly one stays. group_size counts rows. An empty table gives an
    empty one. Columns of df that have the name of a new column are replaced.
    """
    need(df, id_column, text_column)
    added = ("keep_id", "group_size", "kept", "text_sha256")
    df = df.drop(*(c for c in added if c in df.columns and c not in (id_column, text_column)))
    text = text_or_empty(text_column)
    parts = max(LEAST, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    heavy = _heavy(df, text, parts)

    o, s, n, h, ho, hd = (free_name(df, x) for x in ("opening_", "salt_", "norm_", "digest_", "heavy_opening_", "heavy_digest_"))
    known = lambda kind, name: F.broadcast(heavy.filter(F.col("kind") == kind).select(F.col("value").alias(name)))  # noqa: E731  bounded, see _heavy

    def marked(rows: DataFrame) -> DataFrame:
        """rows with the opening, and where it is heavy the digest, and both again where they are heavy."""
        rows = rows.withColumn(o, opening(text)).join(known("o", ho), F.col(o) == F.col(ho), "left")
        rows = rows.withColumn(h, F.when(F.col(ho).isNotNull(), F.sha2(normalised(text), 256)))
        return rows.join(known("d", hd), F.col(h) == F.col(hd), "left")

    salt = lambda *c: F.pmod(F.xxhash64(*c), F.lit(parts)).cast("int")
    own = [c for c, kind in df.dtypes if not re.search("map<|variant", kind)]  # copies with null or equal ids still differ in others
    salted = F.when(F.col(hd).isNotNull(), salt(*own)).when(F.col(ho).isNotNull(), salt(h)).otherwise(0)
    laid = marked(df).withColumn(s, salted).repartitionByRange(o, s)
    laid = laid.withColumn(n, normalised(text))
    run = Window.partitionBy(o, s, n)
    first = run.orderBy(F.col(id_column).asc_nulls_last())
    out = laid.withColumns({
        "keep_id": F.first(id_column).over(first),
        "group_size": F.count(F.lit(1)).over(first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "kept": F.row_number().over(first) == 1,
        "text_sha256": F.sha2(F.col(n), 256),
    })
    # copies of a heavy text are in several windows; its keeper is the least of all
    g, least, size = (free_name(df, x) for x in ("group_", "least_", "size_"))
    place = F.struct(F.col(id_column).isNull(), F.col(id_column).alias("id"), F.col(s).alias("salt"))
    whole = marked(df).withColumn(s, salted).filter(F.col(hd).isNotNull()).groupBy(F.col(hd).alias(g)).agg(F.min(place).alias(least), F.count(F.lit(1)).alias(size))
    out = out.join(F.broadcast(whole), F.col(hd) == F.col(g), "left")  # a short row for each heavy text
    split = F.col(g).isNotNull()
    out = out.withColumns({
        "kept": F.when(split, F.col("kept") & F.col(id_column).eqNullSafe(F.col(least)["id"]) & (F.col(s) == F.col(least)["salt"])).otherwise(F.col("kept")),
        "keep_id": F.when(split, F.col(least)["id"]).otherwise(F.col("keep_id")),
        "group_size": F.when(split, F.col(size)).otherwise(F.col("group_size")),
    })
    return out.drop(o, s, n, h, ho, hd, g, least, size)


def first_copies(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of df that exact_dedup keeps, with df's own columns, whatever their names."""
    need(df, id_column, text_column)
    named = {id_column: "id", text_column: "text"}
    rest = F.struct(F.lit(0).alias("no_clash_"), *(F.col(f"`{c}`") for c in df.columns if c not in named)).alias("row")
    kept = exact_dedup(df.select(*(F.col(f"`{c}`").alias(n) for c, n in named.items()), rest), "id", "text").filter("kept")
    return kept.select(*(F.col(named[c]).alias(c) if c in named else F.col("row")[c].alias(c) for c in df.columns))
