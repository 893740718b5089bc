"""Corpus hygiene: what to remove and why, and quarantine that can be repeated and undone.

A manifest is made of pages' texts and file names alone. A store is a folder of rows partitioned by status and bucket; applying a
manifest moves rows from one status to another by rewriting the buckets it touches, and a journal keeps each move, so
restoring a run moves the same rows back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import descriptive_tokens, fail_signature, longest_paragraph, overlap_ratio, strip_sections
from ..session import delete, exists, written

# Overlap of a canonical copy's name with its text, and of a mismatch; bytes and paragraph of a page that is too small
LEAST_OVERLAP, MISMATCH, LEAST_TOKENS, TINY, LEAST_PARAGRAPH = 0.40, 0.40, 4, 1024, 70


def mismatched(tokens: Column, text: Column) -> Column:
    """Whether a file's text has few of its name's words: of four or more, under two fifths."""
    return (F.size(tokens) >= LEAST_TOKENS) & (overlap_ratio(tokens, text) < MISMATCH)


def manifest(files: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """files(key, path, text) as (key, reason, canonical) of those to remove; reasons are fail_page, no_canonical, name_mismatch and duplicate.

    Files of equal text are a group; its canonical copy is the one whose name agrees best with the text, then the first key. If none agrees
    enough the whole group goes. A mismatch of name and text counts only with another sign: a group, a tiny file, or no
    long paragraph. Where the canonical copy goes, the next best takes its place and stays. Null texts are empty.
    """
    body, name = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(path), F.lit(""))
    tokens = descriptive_tokens(name)
    rows = files.select(
        F.col(key).alias("key"), F.sha2(body, 256).alias("hash"), fail_signature(body).alias("sign"),
        mismatched(tokens, body).alias("mismatch"), ((F.octet_length(body) < TINY) | (longest_paragraph(body) < LEAST_PARAGRAPH)).alias("small"),
    )
    rows = written(rows, "file-facts")
    repeated = rows.groupBy("hash").count().filter("count > 1").select("hash")
    # only files of groups have their text compared with their name without its tail sections
    named = files.select(F.col(key).alias("n_key"), F.sha2(body, 256).alias("hash"), tokens.alias("tokens"), body.alias("body")).join(repeated, "hash", "left_semi")
    named = written(named.select("n_key", F.col("hash").alias("n_hash"), overlap_ratio(F.col("tokens"), strip_sections(F.col("body"))).alias("overlap")), "name-facts")
    best = named.groupBy(F.col("n_hash").alias("g_hash")).agg(F.max("overlap").alias("best"))
    rows = rows.join(named.dropDuplicates(["n_key", "n_hash"]), F.col("key").eqNullSafe(F.col("n_key")) & (F.col("hash") == F.col("n_hash")), "left")
    rows = rows.join(best, F.col("hash") == F.col("g_hash"), "left").withColumn("grouped", F.col("best").isNotNull())
    poison = (
        F.when(F.col("sign").isNotNull(), F.concat(F.lit("fail_page:"), "sign")).when(F.col("grouped") & (F.col("best") < LEAST_OVERLAP), "no_canonical")
        .when(F.col("mismatch") & (F.col("grouped") | F.col("small")), "name_mismatch")
    )
    rows = rows.withColumn("poison", poison)
    # the keeper of each group, by an aggregation that combines copies before the shuffle
    good = rows.filter(F.col("grouped") & F.col("poison").isNull())
    keeper = good.groupBy(F.col("hash").alias("k_hash")).agg(F.min_by("key", F.struct(-F.col("overlap"), F.col("key"))).alias("keeper"))
    rows = rows.join(keeper, F.col("hash") == F.col("k_hash"), "left")
    dropped = F.col("grouped") & F.col("poison").isNull() & ~F.col("key").eqNullSafe(F.col("keeper"))
    reason = F.coalesce("poison", F.when(dropped, "duplicate"))
    return rows.select(F.col("key").alias(key), reason.alias("reason"), F.when(reason == "duplicate", F.col("keeper")).alias("canonical")).filter("reason is not null")


class Quarantine:
    """A store (folder/rows, by status and bucket) with its journal (folder/journal, by run).

    A run is applied in steps that can each be repeated: the moves are written, then the touched buckets' new rows beside the store; only
    when these are whole are the store's partitions overwritten, those left empty deleted, and the run marked done. A run
    that was cut off is finished, or begun anew, by the next call.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, folder: str, key: str):
        self.spark, self.folder, self.key = spark, folder, key

    def create(self, rows: DataFrame) -> None:
        """Writes the store; all rows are active."""
        dealt = rows.withColumns({"status": F.lit("active"), "bucket": self._bucket()})
        dealt.hint("rebalance", "bucket").write.partitionBy("bucket", "status").parquet(f"{self.folder}/rows")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.BUCKETS)).cast("int")

    def rows(self) -> DataFrame:
        """Every row with its status and bucket."""
        return self.spark.read.parquet(f"{self.folder}/rows")

    def journal(self) -> DataFrame:
        """run, key, reason, before and after of every move."""
        return self.spark.read.option("basePath", f"{self.folder}/journal").parquet(f"{self.folder}/journal")

    def apply(self, moves: DataFrame, run: str) -> None:
        """moves(key, reason, status): active rows go to that status. The same run again changes nothing."""
        if self._done(run):
            return
        if not exists(self.spark, f"{self.folder}/journal/run={run}/_SUCCESS"):
            now = self.rows().filter("status = 'active'").select(self.key, F.col("status").alias("before"))
            plan = moves.select(self.key, "reason", F.col("status").alias("after")).dropDuplicates([self.key]).join(now, self.key)
            plan.write.mode("overwrite").parquet(f"{self.folder}/journal/run={run}")
        self._move(run, self.spark.read.parquet(f"{self.folder}/journal/run={run}").select(self.key, F.col("before").alias("from_"), F.col("after").alias("to_")))

    def restore(self, run: str) -> None:
        """Moves a run's rows back to where they were, if they are still where it put them."""
        if not self._done(f"{run}.restored"):
            back = self.spark.read.parquet(f"{self.folder}/journal/run={run}").select(self.key, F.col("after").alias("from_"), F.col("before").alias("to_"))
            self._move(f"{run}.restored", back)

    def _done(self, run: str) -> bool:
        return exists(self.spark, f"{self.folder}/done/{run}/_SUCCESS")

    def _move(self, run: str, moves: DataFrame) -> None:
        staged = f"{self.folder}/staged/{run}"
        touched = moves.select(self._bucket().alias("bucket")).distinct().orderBy("bucket").limit(self.BUCKETS).collect()
        buckets = [r["bucket"] for r in touched]
        if buckets:
            if not exists(self.spark, f"{staged}/_SUCCESS"):
                old = self.rows().filter(F.col("bucket").isin(buckets))
                new = old.join(moves, self.key, "left").withColumn("status", F.when(F.col("status") == F.col("from_"), F.col("to_")).otherwise(F.col("status")))
                new.drop("from_", "to_").write.mode("overwrite").partitionBy("bucket", "status").parquet(staged)
            fresh = self.spark.read.parquet(staged)
            fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "status").parquet(f"{self.folder}/rows")
            kept = {(r["bucket"], r["status"]) for r in fresh.select("bucket", "status").distinct().collect()}
            statuses = {r["status"] for r in self.rows().filter(F.col("bucket").isin(buckets)).select("status").distinct().collect()}
            for b in buckets:
                for s in statuses:
                    if (b, s) not in kept:
                        delete(self.spark, f"{self.folder}/rows/bucket={b}/status={s}")
            self.spark.catalog.refreshByPath(f"{self.folder}/rows")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.folder}/done/{run}")
        delete(self.spark, staged)


def statuses(made: DataFrame) -> DataFrame:
    """A manifest's rows with the status that each reason leads to."""
    return made.withColumn("status", F.when(F.col("reason") == "duplicate", "duplicate").otherwise("poisoned"))


def new_run() -> str:
    return uuid.uuid4().hex
