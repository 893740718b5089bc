"""A content-addressed WARC archive.

Two tables in the shared folder make an archive. `payloads` holds each payload once, compressed, under its
SHA-256; `records` holds for each record its exact header block, its HTTP header block and the digest of its
payload. A record's bytes are header block, blank line, block, and two line ends; a join on the digest gives
them back. Every payload is hashed again when it is read, so a wrong or damaged one can't pass.

Of records with equal payloads of at least MIN_REVISIT bytes the one with the largest id is a response and
the others are revisits of it (WARC 1.1, profile identical-payload-digest). The keeper of a digest comes from
an aggregation that combines before the shuffle; a digest that a third of all pages share is one row there,
and the join with it is one that Spark splits.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialised, need, new_folder

MIN_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"  # of all records of one archive, so that reruns agree
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed by WARC 1.1
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed by RFC 4122, for URLs


def record_id(page_id: object, ordinal: int, prefix: str = "page") -> str:
    """Of a page, or of its row where it has no id."""
    name = f"row:{ordinal}" if page_id is None else f"{prefix}:{page_id}"
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>"


def field_value(value: object) -> str:
    """Any text as a header value, losslessly: everything but letters, digits and -._~ escaped."""
    return quote(str(value), safe="")


def sha1_label(digest: str) -> str:
    """The digest as archives write it: base 32."""
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def target_uri(url: str | None) -> str:
    """The URL as a header value: control characters, spaces and non-ASCII escaped; null and empty: none."""
    return quote(url or "", safe="%:/?#[]@!$&'()*+,;=-._~")


def http_block(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def header_block(page_id: object, ordinal: int, url: str | None, kind: str, refers_to: tuple[object, int], digest: str, block_length: int) -> bytes:
    """A record's named fields, without the blank line that ends them. A null id has no field."""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, ordinal)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: {sha1_label(digest)}", "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {field_value(page_id)}")
    if uri := target_uri(url):
        lines.append(f"WARC-Target-URI: {uri}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(*refers_to)}"]
        if refers_to[0] is not None:
            lines.append(f"X-Refers-To-Page-ID: {field_value(refers_to[0])}")
    lines.append(f"Content-Length: {block_length}")
    return "\r\n".join(lines).encode() + b"\r\n"


def parse_header_block(block: bytes) -> dict[str, str]:
    first, *lines = block.decode().split("\r\n")
    if not re.fullmatch(r"WARC/1\.[01]", first):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    return dict(line.split(": ", 1) for line in lines if line)


def write_archive(df: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", folder: str | None = None) -> str:
    """Writes a record for each row of df; the archive's folder.

    A null payload is an empty one, a null URL or id leaves its field out. Ids are kept in the headers as
    escaped text; rows with a null id or a repeated id are records like others, and revisits refer to the
    largest id, to a null one only where there is no other.
    """
    need(df, id_column, url_column, payload_column)
    spark = df.sparkSession
    folder = folder or new_folder(spark, "warc")
    payload = F.coalesce(F.col(payload_column).cast("string"), F.lit("")).cast("binary")
    pages = df.select(
        F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url"), payload.alias("payload"),
        F.sha2(payload, 256).alias("sha256"), F.sha1(payload).alias("sha1"), F.length(payload).cast("long").alias("bytes"),
    )
    # rows may tie on the largest id; ordinal tells them apart
    index = materialised(pages.drop("payload").withColumn("ordinal", F.monotonically_increasing_id()), "warc-index")
    keepers = index.groupBy("sha256").agg(F.max(F.struct(F.col("id"), F.col("ordinal"))).alias("keeper")).withColumnRenamed("sha256", "k_sha256")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [zlib.compress(p, 6) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), batch.column(2)], names=["sha256", "packed", "bytes"])

    once = arrow_map(pages.select("sha256", "payload", "bytes"), pack, "sha256 string, packed binary, bytes long")
    once = once.groupBy("sha256").agg(F.first("packed").alias("packed"), F.first("bytes").alias("bytes"))
    once.write.parquet(f"{folder}/payloads")

    records = index.join(keepers, F.col("sha256") == F.col("k_sha256"))
    revisit = (F.col("bytes") >= MIN_REVISIT) & (F.col("ordinal") != F.col("keeper.ordinal"))
    records = records.select("id", "url", "sha256", "sha1", "bytes", "ordinal", revisit.alias("revisit"), F.col("keeper.id").alias("k_id"), F.col("keeper.ordinal").alias("k_ordinal"))

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            warc, http = [], []
            for row in batch.to_pylist():
                block = http_block(row["bytes"])
                kind = "revisit" if row["revisit"] else "response"
                length = len(block) + (0 if row["revisit"] else row["bytes"])
                warc.append(header_block(row["id"], row["ordinal"], row["url"], kind, (row["k_id"], row["k_ordinal"]), row["sha1"], length))
                http.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(warc, pa.binary()), pa.array(http, pa.binary()), batch.column(2)], names=["header", "http", "sha256"])

    arrow_map(records, head, "header binary, http binary, sha256 string").write.option("compression", "zstd").parquet(f"{folder}/records")
    return folder


def read_archive(spark: SparkSession, folder: str, full_records: bool = False) -> DataFrame:
    """Each record of the archive, rebuilt: page_id as text, null for null, its type, what it refers to and its whole payload's facts.

    With full_records the bytes of the record and its payload come too. A payload whose SHA-256 or SHA-1
    is not that under which it is stored, or a length that its header doesn't bear out, is an error.
    """
    records = spark.read.parquet(f"{folder}/records")
    payloads = spark.read.parquet(f"{folder}/payloads").withColumnRenamed("sha256", "p_sha256")
    joined = records.join(payloads, F.col("sha256") == F.col("p_sha256")).select("header", "http", "sha256", "packed")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"] + ["record", "payload"] * full_records

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for header, http, sha256, packed in zip(*(batch.column(i).to_pylist() for i in range(4))):
                payload = zlib.decompress(packed)
                sha1 = hashlib.sha1(payload).hexdigest()
                fields = parse_header_block(header)
                kind = fields["WARC-Type"]
                block = http + (payload if kind == "response" else b"")
                if hashlib.sha256(payload).hexdigest() != sha256 or fields["WARC-Payload-Digest"] != sha1_label(sha1):
                    raise ValueError(f"payload {sha256} is not what its digest says")
                if int(fields["Content-Length"]) != len(block):
                    raise ValueError(f"record {fields['WARC-Record-ID']} has a wrong length")
                page, refers = (None if v is None else unquote(v) for v in (fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")))
                row = (page, len(payload), sha1, kind, refers, fields.get("WARC-Target-URI"))
                rows.append(row + (header + b"\r\n" + block + b"\r\n\r\n", payload) * full_records)
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names=names)

    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, target_uri string"
    return arrow_map(joined, rebuild, schema + ", record binary, payload binary" * full_records)
