"""A stored full-text index with positions, kept up to date by a watermark.

A folder holds `postings` (term, doc, tf, dl, positions), partitioned by batch and by a bucket of the term, `docs` (doc, dl,
updated) and `gone` (doc, batch: rows of that batch which no longer count), partitioned by batch; each refresh is a batch. A refresh reads the
source's rows above the last watermark and adds them as a batch; a row that was there before is marked gone in
its old batch, nothing is rewritten. compact() rewrites all batches as one.

A phrase is found by equi joins: places of its first word with those behind them that hold its second, these pairs with
the phrases, and the starts they give with the places of the words that follow. Equal phrases are looked for once. Searches read the buckets of their words only; the join of a hot word is one that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete, shared_folder
from .retrieval import ranked, small

BUCKETS = 64
PART = 8 << 20  # characters of text that a task of a refresh is made for
MANY = 4096  # wanted words up to which buckets are chosen
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6  # fixed values of the ranking


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class TextIndex:
    """doc is of any type that can be joined; updated is a number or time that grows with every change of a row."""

    def __init__(self, spark: SparkSession, doc_type: str, updated_type: str = "bigint", folder: str | None = None):
        self.spark, self.folder = spark, folder or shared_folder(spark, "text-index")
        self.schemas = {
            "postings": f"term string, doc {doc_type}, tf bigint, dl int, positions array<int>, batch int, bucket int",
            "docs": f"doc {doc_type}, dl int, updated {updated_type}, batch int",
            "gone": f"doc {doc_type}, batch int, since int",
        }
        self.batches = 0

    def _table(self, name: str, batches: int | None = None) -> DataFrame:
        """The rows of the batches written so far; a refresh that failed half-way isn't among them."""
        count = self.batches if batches is None else batches
        if not count:
            return self.spark.createDataFrame([], self.schemas[name])
        rows = self.spark.read.schema(self.schemas[name]).parquet(f"{self.folder}/{name}")
        return rows.select(*self._columns(name)).filter(F.col(self._batch(name)) < count)

    def _columns(self, name: str) -> list[str]:
        return self.spark.createDataFrame([], self.schemas[name]).columns

    def _batch(self, name: str) -> str:
        return "since" if name == "gone" else "batch"

    def _write(self, rows: DataFrame, name: str, batch: int, *by: str) -> None:
        rows.write.mode("overwrite").partitionBy(*by).parquet(f"{self.folder}/{name}/{self._batch(name)}={batch}")

    def watermark(self):
        """The largest `updated` seen, null for none."""
        return self._table("docs").agg(F.max("updated")).first()[0]

    def current(self) -> DataFrame:
        """doc, dl, updated, batch of the rows that count."""
        gone = self._table("gone").select("doc", "batch").distinct()
        return self._table("docs").join(gone, ["doc", "batch"], "left_anti")

    def refresh(self, source: DataFrame, doc: str, text: str, updated: str, deleted: DataFrame | None = None) -> int:
        """Adds source's rows whose `updated` is above the watermark, in place of older ones of the same doc; the number of rows read.

        Of several new rows of a doc the last one counts, of equally new ones that with the greater text. deleted(doc) go.
        Null texts are empty; rows without a doc or an updated are left out.
        """
        mark, batch = self.watermark(), self.batches
        new = source if mark is None else source.filter(F.col(updated) > F.lit(mark))
        new = new.select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(updated).alias("updated"))
        new = new.filter("doc is not null and updated is not null")
        # a task's memory depends on its rows, so their number follows the texts
        held = new.agg(F.sum(F.length("text"))).first()[0] or 0
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-held // PART))
        new = new.repartition(tasks, "doc").groupBy("doc").agg(F.max(F.struct("updated", "text")).alias("last")).select("doc", F.col("last.updated").alias("updated"), words(F.col("last.text")).alias("w"))
        tokens = new.select("doc", F.size("w").alias("dl"), F.posexplode("w").alias("position", "term"))
        parts = F.pmod(F.xxhash64("doc"), F.lit(max(1, tasks // 4))).cast("int")
        # one shuffle, by bucket and part of the documents: the grouping's keys contain both
        dealt = tokens.select("*", bucket(F.col("term")).alias("bucket"), parts.alias("part")).repartition(tasks, "bucket", "part")
        rows = dealt.groupBy("bucket", "part", "term", "doc", "dl").agg(F.array_sort(F.collect_list("position")).alias("positions"))
        rows = rows.select("term", "doc", F.size("positions").cast("long").alias("tf"), "dl", "positions", "bucket")
        self._write(rows.sortWithinPartitions("bucket", "term"), "postings", batch, "bucket")
        self._write(new.select("doc", F.size("w").alias("dl"), "updated"), "docs", batch)
        docs = self._table("docs", batch + 1).filter(F.col("batch") == batch)
        old = self.current().select("doc", "batch")
        changed = docs.select("doc")
        gone = old.join(changed if deleted is None else changed.union(deleted.select("doc")), "doc", "left_semi")
        self._write(gone.select("doc", "batch"), "gone", batch)
        self.batches += 1  # only now do readers see the batch
        return docs.count()

    def compact(self) -> None:
        """All batches as one, without the rows that are gone."""
        made = TextIndex(self.spark, "int", folder=shared_folder(self.spark, "text-index"))
        made.schemas, made.batches = self.schemas, 1
        postings = self._counted(self._table("postings")).select("term", "doc", "tf", "dl", "positions", "bucket")
        made._write(postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term"), "postings", 0, "bucket")
        made._write(self.current().select("doc", "dl", "updated"), "docs", 0)
        made._write(self.spark.createDataFrame([], self.schemas["gone"]).select("doc", "batch"), "gone", 0)
        old, self.folder, self.batches = self.folder, made.folder, 1
        delete(self.spark, old)

    def _counted(self, postings: DataFrame) -> DataFrame:
        return postings.join(self._table("gone").select("doc", "batch").distinct(), ["doc", "batch"], "left_anti")

    def postings(self, wanted: DataFrame) -> DataFrame:
        """Postings of wanted(term), from the wanted words' buckets where these are few."""
        rows = self._table("postings")
        buckets = wanted.select(bucket(F.col("term")).alias("b")).distinct().limit(BUCKETS).collect() if wanted.limit(MANY + 1).count() <= MANY else []
        if buckets:
            rows = rows.filter(F.col("bucket").isin([r["b"] for r in buckets]))
        return self._counted(rows.join(small(wanted.select("term").distinct()), "term", "left_semi"))

    def phrases(self, queries: DataFrame) -> DataFrame:
        """queries(query_id, text) as (query_id, doc, hits, dl): documents that hold all words of the text one behind the other, and how often."""
        same, firsts = self._phrases_once(queries)
        return same.join(self._starts(firsts), "first_id").select("query_id", "doc", "hits", "dl")

    def _phrases_once(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(query_id, first_id) of the queries with words, and (first_id, w) of each distinct phrase: equal phrases are looked for once."""
        asked = queries.select("query_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
        firsts = asked.groupBy("w").agg(F.min("query_id").alias("first_id"))
        return asked.join(firsts, "w").select("query_id", "first_id"), firsts

    def _starts(self, firsts: DataFrame) -> DataFrame:
        """firsts(first_id, w) as (first_id, doc, hits, dl).

        Neighbouring places are joined before they meet the phrases, so a word costs its occurrences, however many phrases it begins.
        """
        asked = firsts.select("first_id", "w", F.size("w").alias("n"), F.col("w")[0].alias("a"), F.try_element_at("w", F.lit(2)).alias("b"))
        found = self.postings(firsts.select(F.explode("w").alias("term"))).select("term", "doc", "dl", F.explode("positions").alias("at"))
        ones = found.join(small(asked.filter("n = 1").select("first_id", F.col("a").alias("term"))), "term").select("first_id", "doc", "dl")
        more = asked.filter("n > 1")
        left = found.join(small(more.select(F.col("a").alias("term")).distinct()), "term", "left_semi").select("doc", "dl", F.col("term").alias("a"), F.col("at").alias("start"))
        right = found.join(small(more.select(F.col("b").alias("term")).distinct()), "term", "left_semi").select("doc", F.col("term").alias("b"), (F.col("at") - 1).alias("start"))
        starts = left.join(right, ["doc", "start"]).join(small(more), ["a", "b"])
        twos = starts.filter("n = 2").select("first_id", "doc", "dl")
        rest = starts.filter("n > 2").select("first_id", "n", "doc", "dl", "start", F.posexplode("w").alias("i", "term")).filter("i > 1").withColumn("at", F.col("start") + F.col("i"))
        whole = rest.join(found.select("doc", "at", "term"), ["doc", "at", "term"]).groupBy("first_id", "n", "doc", "dl", "start").count().filter("count = n - 2").select("first_id", "doc", "dl")
        return ones.unionAll(twos).unionAll(whole).groupBy("first_id", "doc", "dl").agg(F.count(F.lit(1)).alias("hits"))

    def ranked_phrases(self, queries: DataFrame, limit: int | None = None, keep: DataFrame | None = None) -> DataFrame:
        """phrases() with score, BM25 of the phrase as one term, and rank; of keep(doc) only, if given; counts are those of all documents."""
        totals = self.current().agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl"))
        same, firsts = self._phrases_once(queries)
        found = self._starts(firsts)
        df = found.groupBy("first_id").agg(F.count(F.lit(1)).alias("df"))
        rows = found.join(df, "first_id").crossJoin(F.broadcast(totals))  # one row of totals
        idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        norm = F.col("hits") * (K1 + 1) / (F.col("hits") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
        rows = rows.select("first_id", "doc", "hits", F.round(F.greatest(idf, F.lit(LEAST_IDF)) * norm, 6).alias("score"))
        if keep is not None:
            rows = rows.join(keep.select("doc"), "doc", "left_semi")
        best = ranked(rows, ["first_id"], F.desc("score"), F.col("doc"), limit=limit)  # only these are given to each query of the phrase
        return same.join(best, "first_id").drop("first_id")
