"""Sources and sinks: newline-delimited JSON, JSONL logs, document trees, URL lists and Atom feeds.

Schemas are stated, never inferred: inference needs a pass of its own and changes types with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

PAPER = "corpusid long, title string, year long, citationcount long, s2fieldsofstudy array<struct<category: string, source: string>>"


def read_ndjson(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """JSON objects, one a line, plain or gzipped."""
    return spark.read.schema(schema).json(paths)


def write_ndjson(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).option("compression", "gzip").json(path)


def ingest_shards(spark: SparkSession, source: str, schema: str, target: str, state: str) -> int:
    """Appends the shards of `source` that no earlier call has taken to the Parquet table `target`.

    The stream's checkpoint in `state` is the record of shards done, so a call after a failure goes on where
    it stopped and a repeated one adds nothing. The number of batches that ran.
    """
    stream = spark.readStream.schema(schema).json(source)
    q = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(p["numInputRows"] > 0 for p in q.recentProgress)


# Number of each stage's records in a log folder; 99 for a stage of another name
STAGE_NUMBERS = (
    ("decompose", "01"), ("stepback", "02"), ("milvus", "03"), ("rerank", "04"), ("mmr", "05"), ("synthesis", "06"), ("grader", "07"), ("crag_retry", "08"), ("paperqa_rerank", "10"), ("paperqa_read", "11"),
    ("paperqa_answer", "12"), ("hipporag_entities", "13"), ("hipporag_walk", "14"), ("hipporag_synthesize", "15"), ("lazygraph_route", "16"), ("lazygraph_community", "17"), ("lazygraph_summarize", "18"),
    ("fused_dispatch", "20"), ("fused_rerank", "21"),
)


def write_stages(df: DataFrame, path: str, stage: str = "stage") -> None:
    """Appends stage records as JSON, a folder NN_name for each stage; a stage of an unknown or null name has number 99."""
    number = F.lit("99")
    for name, n in STAGE_NUMBERS:
        number = F.when(F.col(stage) == name, n).otherwise(number)
    folder = F.concat(number, F.lit("_"), F.coalesce(stage, F.lit("")))
    df.withColumn("_folder", folder).write.mode("append").partitionBy("_folder").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Appends records as JSON lines; each write adds files, so writers need no lock and readers see whole writes."""
    df.write.mode("append").json(path)


def decode_blobs(df: DataFrame, key: str, blob: str, to: str = "text") -> DataFrame:
    """key and the text of each Zstandard blob of UTF-8, null for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = [None if b is None else read.decompressobj().decompress(b).decode() for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, to])

    return df.select(key, blob).mapInArrow(run, StructType([df.schema[key], StructField(to, StringType())]))


def encode_blobs(df: DataFrame, key: str, text: str, to: str = "blob", level: int = 3) -> DataFrame:
    """key and each text as a Zstandard blob."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            blobs = [None if t is None else write.compress(t.encode()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=[key, to])

    return df.select(key, text).mapInArrow(run, StructType([df.schema[key], StructField(to, BinaryType())]))


def read_document_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path and text of every file below root but those in administrative folders, whose names begin with _."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).filter(~F.regexp_like("path", F.lit("/_[^/]*/")))


def read_audit_tree(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The records of a tree of JSON lines files; malformed lines are skipped."""
    lines = spark.read.option("recursiveFileLookup", "true").text(root)
    rows = lines.select(F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return rows.select("r.*").filter("_bad is null").drop("_bad")


def parse_sidecar(text: Column, schema: str) -> Column:
    """JSON of the schema, also where it was encoded twice; null if it is neither."""
    inner = F.get_json_object(F.concat(F.lit('{"x":'), text, F.lit("}")), "$.x")
    return F.from_json(F.when(F.startswith(F.trim(text), F.lit('"')), inner).otherwise(text), schema)


def url_lines(line: Column) -> Column:
    """struct(title, url) of a line `title || url` or `url`; null for blanks and comments."""
    parts = F.split(line, r"\|\|", 2)
    both = F.size(parts) > 1
    url = F.trim(F.when(both, parts[1]).otherwise(parts[0]))
    title = F.when(both, F.trim(parts[0]))
    return F.when((F.trim(line) != "") & ~F.startswith(F.trim(line), F.lit("#")), F.struct(title.alias("title"), url.alias("url")))


ATOM = "id string, title string, published string, author array<struct<name: string>>"


def write_atom(df: DataFrame, path: str) -> None:
    """Rows of id, title, published and author (an array of names) as Atom files."""
    df.write.format("xml").option("rootTag", "feed").option("rowTag", "entry").option("declaration", "").save(path)


def read_atom(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """id, title, published and authors of each entry of Atom files; Spark's XML source splits large ones and reads an entry as a row."""
    rows = spark.read.format("xml").option("rowTag", "entry").schema(ATOM).load(paths)
    return rows.select("id", "title", "published", F.transform("author", lambda a: a["name"]).alias("authors"))


def last_by_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key: later log lines replace earlier ones."""
    w = Window.partitionBy(*keys).orderBy(*(o.desc() for o in order))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def validated(df: DataFrame, required: list[str]) -> DataFrame:
    """df with `missing`, the required columns that a row lacks, comma-separated; empty if it is complete."""
    lacking = F.array_compact(F.array(*(F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(c)) for c in required)))
    return df.withColumn("missing", F.array_join(lacking, ","))
