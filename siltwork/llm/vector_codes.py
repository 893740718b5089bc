"""Product quantisation of vectors in whole numbers, its codebooks by Elkan's form of Lloyd's algorithm.

A component x is the integer floor(4096 x); vectors are cut into PARTS equal parts, each with a codebook of up to
ENTRIES entries. Each row keeps, for each part, its entry, an upper bound of the distance to it and one lower
bound for each entry, as half-precision numbers rounded outwards. A round shifts the bounds by how far the entries
moved, and an entry is only looked at where neither its lower bound nor half its distance from the row's entry is
strictly above the upper bound; so whatever is left out is strictly farther. What is looked at is decided by
squared distances in 64-bit integers, ties by the lower index, and these make the bounds exact again.

Rows with their bounds are a written table, a new one for each round, which replaces the one before; tasks add up
their rows by entry, so the driver sees one row of sums for each component of each entry.

Defined results: rows whose vector is null or holds a null or a non-finite component go. So do those of another length than the
smallest id's among vectors whose length is a positive multiple of PARTS. Components saturate at 2^28 (65,536
before), where a squared distance still fits a long. Null ids come last in the first codebooks, equal ids by their
components. With fewer rows than ENTRIES the codebooks have as many entries as there are rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, materialised, need

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
MOST = 1 << 28
BATCH = 4096  # rows looked at together


def down(x: np.ndarray) -> np.ndarray:
    """Half-precision numbers that aren't above x, at least 0."""
    x = np.minimum(np.maximum(x * (1 - 1e-15), 0), 65504.0)
    h = x.astype(np.float16)
    return np.where(h.astype(np.float64) > x, np.nextafter(h, np.float16(0)), h)


def up(x: np.ndarray) -> np.ndarray:
    """Half-precision numbers that aren't below x; infinite beyond their range."""
    x = x * (1 + 1e-15)
    with np.errstate(over="ignore"):
        h = x.astype(np.float16)
        return np.where(h.astype(np.float64) < x, np.nextafter(h, np.float16(np.inf)), h)


@dataclass
class Codebooks:
    """entries (part, entry, component), and how far each entry came since the bounds were made."""

    entries: np.ndarray
    moved: np.ndarray | None = None

    def apart(self) -> np.ndarray:
        """Half the distance of each two entries of a part."""
        gap = self.entries[:, :, None, :] - self.entries[:, None, :, :]
        return np.sqrt((gap * gap).sum(axis=3).astype(np.float64)) * 0.5 * (1 - 1e-15)

    def updated(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        new = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], self.entries)
        gap = new - self.entries
        return Codebooks(new, np.sqrt((gap * gap).sum(axis=2).astype(np.float64)) * (1 + 1e-15))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def squared(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    gap = x - entry
    return np.einsum("ij,ij->i", gap, gap)


def assign(x: np.ndarray, books: Codebooks, code: np.ndarray | None, bounds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes (row, part), bounds (row, part, upper then lower ones), exact squared distances where looked at (else -1), and how many were.

    x is (row, part, component) in int64. Without code and bounds all rows begin at entry 0, their distances unknown.
    """
    rows, parts, width = x.shape
    k = books.entries.shape[1]
    apart = books.apart()
    if code is None:
        code, bounds = np.zeros((rows, parts), dtype=np.uint8), np.zeros((rows, parts, k + 1), dtype=np.float16)
        bounds[:, :, 0] = np.inf
    code, bounds = code.copy(), bounds.copy()
    exact, looked = np.full((rows, parts), -1, dtype=np.int64), 0
    every = np.arange(rows)
    for p in range(parts):
        own = code[:, p].astype(np.int64)
        upper, lower = bounds[:, p, 0].astype(np.float64), bounds[:, p, 1:].astype(np.float64)
        if books.moved is not None:
            upper, lower = upper + books.moved[p][own], lower - books.moved[p]
        open_ = (lower <= upper[:, None]) & (apart[p][own] <= upper[:, None])
        open_[every, own] = False
        todo = np.flatnonzero(open_.any(axis=1))
        best = squared(x[todo, p], books.entries[p][own[todo]])
        root = np.sqrt(best.astype(np.float64))
        upper[todo] = root * (1 + 1e-15)
        lower[todo, own[todo]] = root * (1 - 1e-15)
        looked += len(todo)
        still = open_[todo] & (lower[todo] <= upper[todo, None]) & (apart[p][own[todo]] <= upper[todo, None])
        at, entry = np.nonzero(still)
        distance = squared(x[todo[at], p], books.entries[p][entry])
        looked += len(at)
        lower[todo[at], entry] = np.sqrt(distance.astype(np.float64)) * (1 - 1e-15)
        all_ = np.full((len(todo), k), np.iinfo(np.int64).max)
        all_[at, entry] = distance
        all_[np.arange(len(todo)), own[todo]] = best
        chosen = all_.argmin(axis=1)  # the first of equal ones
        best = all_[np.arange(len(todo)), chosen]
        code[todo, p], exact[todo, p] = chosen, best
        upper[todo] = np.sqrt(best.astype(np.float64)) * (1 + 1e-15)
        bounds[:, p, 0], bounds[:, p, 1:] = up(upper), down(lower)
    return code, bounds, exact, looked


def whole_numbers(embeddings: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """id, label, vec: the rows that stay, their components as whole numbers."""
    need(embeddings, id_column, vector_column, label_column)
    x = F.col("v").cast("array<double>")
    rows = embeddings.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"), F.col(vector_column).alias("v"))
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.least(F.greatest(F.floor(c * SCALE), F.lit(-MOST)), F.lit(MOST)).cast("int"))
    return rows.filter(F.col("v").isNotNull() & sound & (F.size("v") > 0) & (F.size("v") % PARTS == 0)).select("id", "label", whole.alias("vec"))


def _round(table: DataFrame, books: Codebooks, name: str, last: bool) -> DataFrame:
    """table with new codes and bounds, or with the code's text and the error; and a row of sums of each task (kind 1)."""
    head = ", ".join(f"{c} {table.schema[c].dataType.simpleString()}" for c in ("id", "label"))
    fresh = "code" not in table.columns
    _, k, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((PARTS, k, width), dtype=np.int64), np.zeros((PARTS, k), dtype=np.int64)
        likes = None
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                likes = batch.columns[:2]
                n = batch.num_rows
                x = batch.column(2).flatten().to_numpy().astype(np.int64).reshape(n, PARTS, width)
                code = bounds = None
                if not fresh:
                    code = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint8).reshape(n, PARTS)
                    bounds = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=np.float16).reshape(n, PARTS, k + 1)
                code, bounds, _, _ = assign(x, books, code, bounds)
                if last:
                    error = sum(squared(x[:, p], books.entries[p][code[:, p]]) for p in range(PARTS))
                    shown = [row.tobytes().hex() for row in code]
                    yield pa.RecordBatch.from_arrays([*likes, pa.array(shown), pa.array(error)], names=["id", "label", "code", "error"])
                    continue
                for p in range(PARTS):
                    counts[p] += np.bincount(code[:, p], minlength=k)
                    np.add.at(sums[p], code[:, p], x[:, p])
                columns = [*batch.columns[:3], pa.array([c.tobytes() for c in code], pa.binary()), pa.array([b.tobytes() for b in bounds], pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.list_(pa.int64())), pa.array(np.zeros(n, dtype=np.int32))], names=names)
        if likes is not None and not last:
            numbers = pa.array([np.concatenate([sums.ravel(), counts.ravel()])], pa.list_(pa.int64()))
            nothing = [pa.nulls(1, c.type) for c in likes]
            yield pa.RecordBatch.from_arrays([*nothing, pa.nulls(1, pa.list_(pa.int32())), *[pa.nulls(1, pa.binary())] * 2, numbers, pa.array([1], pa.int32())], names=names)

    names = ["id", "label", "vec", "code", "bounds", "sums", "kind"]
    if last:
        return materialised(arrow_map(table, run, f"{head}, code string, error long"), name)
    return materialised(arrow_map(table, run, f"{head}, vec array<int>, code binary, bounds binary, sums array<bigint>, kind int"), name, ["kind"])


def codebooks(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """The first codebooks: the parts of the rows with the smallest ids."""
    least = table.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).select("vec").collect()
    first = np.array([r["vec"] for r in least], dtype=np.int64)
    return Codebooks(np.ascontiguousarray(first.reshape(len(first), parts, -1).transpose(1, 0, 2)))


def compressed(embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """id, code (two hex digits a part), error, label_error and codebooks_sha256 of each row that stays."""
    table = materialised(whole_numbers(embeddings, id_column, vector_column, label_column), "vectors")
    first = table.orderBy(F.col("id").asc_nulls_last(), "vec").select(F.size("vec").alias("n")).first()
    same = table.filter(F.size("vec") == (first["n"] if first else PARTS))
    books = codebooks(same) if first else Codebooks(np.zeros((PARTS, 1, 1), dtype=np.int64))
    before = table
    for i in range(rounds):
        made = _round(same, books, f"round-{i}", False)
        discard(before)
        before, same = made, made.filter("kind = 0").select("id", "label", "vec", "code", "bounds")
        added = made.filter("kind = 1").select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
        numbers = np.zeros(books.entries.size + books.entries[:, :, 0].size, dtype=np.int64)
        for r in added.collect():  # a number for each component of each entry
            numbers[r["at"]] = r["n"]
        sums, counts = numbers[: books.entries.size].reshape(books.entries.shape), numbers[books.entries.size :].reshape(books.entries.shape[:2])
        books = books.updated(sums, counts)
    done = _round(same, books, "codes", True)
    discard(before)
    by = done.groupBy(F.col("label").alias("l_label")).agg(F.sum("error").alias("label_error"))
    rows = done.join(by, F.col("label").eqNullSafe(F.col("l_label")))
    return rows.select(F.col("id").alias(id_column), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
