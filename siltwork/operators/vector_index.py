"""Approximate dense search by an inverted file: cells of k-means, compressed residuals, exact reranking.

The index is a folder: `cells` has the centroids, `rows` a row for each vector, partitioned by cell, with a code of
one byte a component (the residual to the centroid, scaled by its largest component) and the vector itself. A
search reads the codes of the cells it probes and of no others, keeps a short list for each query, and reads
the vectors of the short lists only. Queries are searched in bands of neighbouring cells, so that a band
with its short lists holds a bounded number of bytes and probes few cells. A task keeps one short list for each query of its
band over all cells it reads, and there are no more tasks than cores: what is shuffled doesn't grow with the cells.

Centroids are fitted on at most PER_CELL drawn vectors for each cell; all vectors are indexed. Vectors that are null, hold a null
or have another length than most are left out: they have no cosine to anything. A vector without length is in
some cell and has cosine 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, ship
from .retrieval import SMALL_BYTES, cosine, matrix, ranked, sound

PER_CELL = 64  # drawn vectors for each cell that k-means sees
MOST_CELLS = 4096  # bounds the centroids that every task gets
SHORT = 8  # times k candidates that are reranked exactly
SCORES = 1 << 22  # scores that a task holds at once
ENTRY = 24  # bytes of an entry of a short list in a task
OUT = 1 << 16  # rows of a batch of short lists


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)


@dataclass
class VectorIndex:
    folder: str
    centroids: np.ndarray
    id_type: str

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"id {self.id_type}, code binary, scale float, vector array<float>, cell int").parquet(f"{self.folder}/rows")


def cells_for(vectors: int) -> int:
    return min(MOST_CELLS, max(1, round(math.sqrt(vectors))))


def build(vectors: DataFrame, key: str, vector: str, cells: int | None = None, folder: str | None = None, seed: int = 7) -> VectorIndex:
    """The index of vectors(key, vector), written to folder (by default one that goes with the application)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("vector")).filter(sound(F.col("vector")) & (F.size("vector") > 0))
    sizes = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    folder, id_type = folder or shared_folder(spark, "vectors"), rows.schema["id"].dataType.simpleString()
    dims, total = (sizes["dims"], sizes["count"]) if sizes else (1, 0)
    rows = rows.filter(F.size("vector") == dims)
    cells = cells or cells_for(total)
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
    drawn = rows.orderBy(F.xxhash64("vector", F.lit(seed)), "id").limit(cells * PER_CELL).filter(length > 0)
    drawn = drawn.select(array_to_vector(F.transform("vector", lambda c: c.cast("double") / length)).alias("features"))
    if total and drawn.limit(1).count():
        model = KMeans(k=max(2, cells), seed=seed, maxIter=8, initMode="random").fit(drawn.cache())
        centroids = np.array(model.clusterCenters(), dtype=np.float32)
        drawn.unpersist()
    else:
        centroids = np.zeros((1, dims), dtype=np.float32)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<float>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/cells")
    shared = spark.sparkContext.broadcast(centroids)  # at most MOST_CELLS vectors

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            u = unit(matrix(batch.column(1)))
            cell = nearest(u, c, 1)[:, 0]
            residual = u - c[cell]
            scale = np.maximum(np.abs(residual).max(axis=1), 1e-30) / 127
            code = np.rint(residual / scale[:, None]).astype(np.int8)
            columns = [batch.column(0), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(scale.astype(np.float32)), batch.column(1), pa.array(cell.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "code", "scale", "vector", "cell"])

    coded = rows.mapInArrow(encode, f"id {id_type}, code binary, scale float, vector array<float>, cell int")
    # a cell is one file where it can be, and as many as it needs where it holds a large share of the rows
    coded.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/rows")
    return VectorIndex(folder, centroids, id_type)


def load(spark: SparkSession, folder: str) -> VectorIndex:
    """An index that was built before."""
    rows = spark.read.parquet(f"{folder}/cells").orderBy("cell").collect()  # at most MOST_CELLS
    kind = spark.read.parquet(f"{folder}/rows").schema["id"].dataType.simpleString()
    return VectorIndex(folder, np.array([r["centroid"] for r in rows], dtype=np.float32), kind)


def nearest(u: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each row, nearest first."""
    far = (centroids * centroids).sum(axis=1) - 2 * (u @ centroids.T)
    n = min(n, len(centroids))
    return np.argsort(far, axis=1, kind="stable")[:, :n]


def _bands(sizes: list[tuple[int, int]], most: int) -> tuple[list[list[int]], dict[int, int]]:
    """First cells in bands of some `most` bytes; and for a cell that has more, into how many parts its queries go."""
    bands, now, used, split = [], [], 0, {}
    for cell, size in sizes:
        if size > most:
            split[cell] = -(-size // most)
        elif now and used + size > most:
            bands.append(now)
            now, used = [cell], size
        else:
            now.append(cell)
            used += size
    return bands + [now] * bool(now), split


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int, short: int = SHORT, most: int = SMALL_BYTES) -> DataFrame:
    """queries(query_id, vector) as (query_id, id, score, rank) by cosine, the best k among the short lists of `probes` cells."""
    spark = queries.sparkSession
    c, dims = index.centroids, index.centroids.shape[1]
    shared = spark.sparkContext.broadcast(c)
    kind = dict(queries.dtypes)["query_id"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = nearest(unit(matrix(batch.column(1))), shared.value, probes)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["query_id", "vector", "cells"])

    asked = queries.select("query_id", F.col("vector").cast("array<float>").alias("vector")).filter(sound(F.col("vector")) & (F.size("vector") == dims))
    asked = asked.mapInArrow(probe, f"query_id {kind}, vector array<float>, cells array<int>").withColumn("first", F.col("cells")[0])
    sizes = asked.groupBy("first").count().orderBy("first").collect()  # a row a cell
    bands, split = _bands([(r["first"], r["count"] * (dims * 8 + 64 + k * short * ENTRY)) for r in sizes], most)
    parts = [asked.filter(F.col("first").isin(b)) for b in bands]
    parts += [asked.filter((F.col("first") == cell) & (F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)) for cell, n in split.items() for i in range(n)]
    found = spark.createDataFrame([], f"query_id {kind}, id {index.id_type}, cell int, near float")
    for part in parts:
        found = found.union(_short_lists(index, part, k * short, spark))
    lists = ranked(found, ["query_id"], F.desc("near"), F.col("id"), limit=k * short).select("query_id", "id", "cell")
    rows = index.rows(spark).select(F.col("id").alias("r_id"), F.col("cell").alias("r_cell"), F.col("vector").alias("v"))
    pairs = lists.join(rows, (F.col("cell") == F.col("r_cell")) & F.col("id").eqNullSafe(F.col("r_id"))).join(asked.select("query_id", "vector"), "query_id")
    scored = pairs.select("query_id", "id", F.round(cosine(F.col("vector"), F.col("v")), 6).alias("score"))
    return ranked(scored, ["query_id"], F.desc("score"), F.col("id"), limit=k)


class _Shortest:
    """The best `short` entries of each query (near downwards, id upwards) of all that a task adds."""

    def __init__(self, queries: int, short: int):
        self.short, self.least = short, np.full(queries, -np.inf, dtype=np.float32)  # what an entry must reach
        self.held: list[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]] = []
        self.count, self.most = 0, max(OUT, 2 * short * queries)

    def add(self, query: np.ndarray, ids: pa.Array, cell: int, near: np.ndarray) -> None:
        self.held.append((query.astype(np.int32), ids, np.full(len(query), cell, dtype=np.int32), near.astype(np.float32)))
        self.count += len(query)
        if self.count > self.most:
            self.cut()

    def cut(self) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray] | None:
        """All that is held, cut to the best of each query."""
        if not self.held:
            return None
        query, cell, near = (np.concatenate([h[i] for h in self.held]) for i in (0, 2, 3))
        ids = pa.concat_arrays([h[1] for h in self.held])
        place = np.empty(len(ids), dtype=np.int64)
        place[pc.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
        order = np.lexsort((place, -near, query))
        sorted_query = query[order]
        nth = np.arange(len(order)) - np.searchsorted(sorted_query, sorted_query)
        last = order[nth == self.short - 1]
        self.least[query[last]] = near[last]
        best = order[nth < self.short]
        kept = query[best], ids.take(pa.array(best)), cell[best], near[best]
        self.held, self.count = [kept], len(best)
        return kept


def _short_lists(index: VectorIndex, asked: DataFrame, short: int, spark: SparkSession) -> DataFrame:
    """(query_id, id, cell, near) of a band of queries: each task's best `short` of each query, by the codes."""
    rows = asked.collect()  # of a band's bounded size
    wanted: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        for cell in r["cells"]:
            wanted.setdefault(cell, []).append(i)
    ids = [r["query_id"] for r in rows]
    q = unit(np.array([r["vector"] for r in rows], dtype=np.float32).reshape(len(rows), index.centroids.shape[1]))
    at_cell = {cell: np.array(i) for cell, i in wanted.items()}
    shared = spark.sparkContext.broadcast((pa.array(ids), q, at_cell, index.centroids))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asking, of, centroids = shared.value
        lists = _Shortest(len(asking), short)
        for batch in batches:
            cells = batch.column(3).to_numpy()
            for cell in np.unique(cells):
                at = np.flatnonzero(cells == cell)
                mine = of[int(cell)]
                code = np.frombuffer(b"".join(batch.column(1).take(pa.array(at)).to_pylist()), dtype=np.int8).reshape(len(at), -1)
                near = code.astype(np.float32) * batch.column(2).to_numpy()[at][:, None] + centroids[cell]
                step = max(1, SCORES // len(at))
                for s in range(0, len(mine), step):
                    score = asking[mine[s : s + step]] @ near.T
                    least = lists.least[mine[s : s + step], None]
                    if short < score.shape[1]:
                        least = np.maximum(least, -np.partition(-score, short - 1, axis=1)[:, short - 1 : short])
                    row, col = np.nonzero(score >= least)
                    lists.add(mine[s + row], batch.column(0).take(pa.array(at[col])), int(cell), score[row, col])
        kept = lists.cut()
        for s in range(0, len(kept[0]) if kept else 0, OUT):
            query, keys, cell, near = (x[s : s + OUT] for x in kept)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), keys, pa.array(cell), pa.array(near)], names=["query_id", "id", "cell", "near"])

    probed = index.rows(spark).filter(F.col("cell").isin(sorted(at_cell))).select("id", "code", "scale", "cell")
    probed = probed.coalesce(spark.sparkContext.defaultParallelism)  # small files of cells; each task passes a short list of each query on
    return probed.mapInArrow(best, f"query_id {dict(asked.dtypes)['query_id']}, id {index.id_type}, cell int, near float")
