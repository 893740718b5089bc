"""Lexical and dense search, fusion, reranking and diversity, for many queries in one job.

Ranked lists are rows with an explicit rank; nothing depends on row order. Query sets are small next to the
corpus; where one is broadcast, its size is checked first (small).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

SMALL_BYTES = 32 << 20  # of values as text, up to which a query set is broadcast; of vectors searched at once


def small(df: DataFrame, most: int = SMALL_BYTES) -> DataFrame:
    """df with a broadcast hint if its values take at most that many bytes; beyond that Spark chooses a shuffled join."""
    size = F.lit(8 * len(df.columns)) + sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most else df


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-zß-öø-ÿ0-9]+"), F.lit(0))


def postings(df: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """(term, doc, tf, dl) of the wanted terms, and for each document a row of its own with an empty term and tf 0.

    The texts are read and cut into words once. Other words are dropped before anything is counted or shuffled.
    """
    words = df.select(F.col(key).alias("doc"), tokens(F.col(text)).alias("w"))
    rows = words.select("doc", F.size("w").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "w")).alias("term"))
    known = wanted.select("term").union(wanted.sparkSession.range(1).select(F.lit("").alias("term")))
    rows = rows.join(small(known), "term", "left_semi")
    return rows.groupBy("doc", "dl", "term").agg(F.count(F.when(F.col("term") != "", 1)).alias("tf")).select("term", "doc", "tf", "dl")


def ranked(df: DataFrame, by: list[str], *order: Column, limit: int | None = None) -> DataFrame:
    """df with rank inside each group, cut at limit; Spark prunes each task to its first rows before the shuffle."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if limit is None else out.filter(F.col("rank") <= limit)


def bm25(docs: DataFrame, queries: DataFrame, key: str, text: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """queries(query_id, text) as (query_id, id, score, rank), best k, idf = ln(1 + (N - df + .5) / (df + .5)).

    Postings of the query terms are written once; lengths, document frequencies and scores come from these.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    post = written(postings(docs, key, text, asked.select("term").distinct()), "postings")
    lengths = post.filter("term = ''").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl"))
    post = post.filter("term <> ''")
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = df.crossJoin(F.broadcast(lengths)).select("term", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avg_dl")  # one row of totals
    rows = post.join(small(asked).join(weights, "term"), "term")
    norm = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    scores = rows.groupBy("query_id", F.col("doc").alias("id")).agg(F.round(F.sum(F.col("idf") * norm), 6).alias("score"))
    return ranked(scores, ["query_id"], F.desc("score"), F.col("id"), limit=k)


def cosine(a: Column, b: Column) -> Column:
    """In double; 0 for a vector without length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def sound(vector: Column) -> Column:
    """Whether a vector is there and holds numbers only."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c))


def matrix(column: pa.Array, kind: type = np.float32) -> np.ndarray:
    """A column of equally long lists as rows of numbers, without a Python object for each."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def dense(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, most: int = SMALL_BYTES) -> DataFrame:
    """queries(query_id, vector) as (query_id, id, score, rank) by cosine, exact, best k.

    Query vectors go to all tasks in bands of some `most` bytes, each band in a scan of its own, so that
    neither the driver nor a task holds more than a band. A task multiplies matrices over its batches and
    passes on its best k of each query: what is shuffled is tasks x queries x k rows. Vectors that are null, hold a
    null or have another length than the longest query are left out, on both sides.
    """
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).filter(sound(F.col("vector")))
    size = asked.agg(F.sum(F.lit(16) + 8 * F.size("vector")).alias("bytes"), F.max(F.size("vector")).alias("dims")).first()
    total, dims = size["bytes"] or 0, size["dims"] or 0
    asked = asked.filter(F.size("vector") == dims)
    vectors = vectors.filter(sound(F.col(vector)) & (F.size(vector) == dims))
    kind = dict(vectors.dtypes)[key]
    bands = -(-total // most)
    found = vectors.sparkSession.createDataFrame([], f"query_id {dict(asked.dtypes)['query_id']}, id {kind}, score double")
    for band in range(bands):
        mine = asked if bands == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(bands)) == band)
        found = found.union(_band(vectors.select(key, vector), mine, k, found.schema))
    return ranked(found, ["query_id"], F.desc("score"), F.col("id"), limit=k)


def _band(vectors: DataFrame, asked: DataFrame, k: int, schema) -> DataFrame:
    rows = asked.collect()  # of bounded size
    q_ids = [r["query_id"] for r in rows]
    q = np.array([r["vector"] for r in rows], dtype=np.float64).reshape(len(rows), len(rows[0]["vector"]) if rows else 0)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    shared = vectors.sparkSession.sparkContext.broadcast((q_ids, q))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit = shared.value
        ids = pa.array(ids)
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            v = matrix(batch.column(1), np.float64)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            keys = batch.column(0)
            for s in range(0, len(ids), 256):
                score = np.round(unit[s : s + 256] @ v.T, 6)
                # keep ties at the cut: the window behind decides them by id
                cut = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k] if k < score.shape[1] else np.full((len(score), 1), -2.0)
                row, col = np.nonzero(score >= cut)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(s + row)), keys.take(pa.array(col)), pa.array(score[row, col])], names=["query_id", "id", "score"])

    return vectors.mapInArrow(best, schema)


def rrf(lists: DataFrame, by: list[str], limit: int | None = None, k: int = 60) -> DataFrame:
    """lists(by, list_idx, id, rank) fused: by, id, rrf, lists (indices in order), first_list, rank."""
    fused = lists.groupBy(*by, "id").agg(
        F.sum(1 / (k + F.col("rank"))).alias("rrf"), F.array_sort(F.collect_set("list_idx")).alias("lists"), F.min(F.struct("list_idx", "rank")).alias("first")
    )
    fused = fused.withColumn("rrf", F.round("rrf", 9)).withColumn("first_list", F.col("first.list_idx")).drop("first")
    return ranked(fused, by, F.desc("rrf"), F.col("id"), limit=limit)


def rerank(hits: DataFrame, by: list[str], k: int, threshold: float | None = None, per_parent: int = 2, floor: int = 5, pool: int | None = None) -> DataFrame:
    """hits(by, id, parent_id, score): best score of each id, threshold with a floor, a cap per parent, best k; as rank.

    If nothing in a group passes, its best `floor` stay.
    """
    best = hits.groupBy(*by, "id").agg(F.max("score").alias("score"), F.min("parent_id").alias("parent_id"))
    best = ranked(best, by, F.desc("score"), F.col("id"), limit=pool).withColumnRenamed("rank", "_pos")
    if threshold is not None:
        passes = F.col("score") >= threshold
        best = best.withColumn("_any", F.max(passes).over(Window.partitionBy(*by))).filter(passes | (~F.col("_any") & (F.col("_pos") <= floor))).drop("_any")
    capped = best.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "parent_id").orderBy(F.desc("score"), "id"))).filter(F.col("_n") <= per_parent)
    return ranked(capped.drop("_pos", "_n"), by, F.desc("score"), F.col("id"), limit=k)


def mmr_order(score: np.ndarray, vectors: np.ndarray, k: int, balance: float) -> list[int]:
    """Greedy picks: balance x min-max relevance - (1 - balance) x largest cosine to a pick; ties go to the first."""
    n = len(score)
    span = score.max() - score.min() if n else 0
    relevance = (score - score.min()) / span if span else np.ones(n)
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    nearest, left, picks = np.zeros(n), np.ones(n, dtype=bool), []
    for _ in range(min(k, n)):
        value = np.where(left, balance * relevance - (1 - balance) * nearest if picks else relevance, -np.inf)
        at = int(np.argmax(np.round(value, 12)))
        picks.append(at)
        left[at] = False
        similar = unit @ unit[at]
        nearest = np.maximum(nearest, similar) if len(picks) > 1 else similar
    return picks


def mmr(pool: DataFrame, by: str, k: int, balance: float = 0.6) -> DataFrame:
    """pool(by, id, score, vector), a bounded number of rows a group, as by, id, pick_order, rank (by score)."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True], ignore_index=True)
        if pdf["vector"].isna().any():
            raise ValueError("a candidate has no vector")
        order = mmr_order(pdf["score"].to_numpy(), np.array(pdf["vector"].tolist(), dtype=float), k, balance) if len(pdf) > k else list(range(len(pdf)))
        out = pdf.iloc[order]
        return pd.DataFrame({by: out[by], "id": out["id"], "pick_order": range(1, len(out) + 1), "rank": out.index + 1})

    kinds = dict(pool.dtypes)
    return pool.groupBy(by).applyInPandas(pick, f"{by} {kinds[by]}, id {kinds['id']}, pick_order int, rank int")


def within_budget(df: DataFrame, by: list[str], size: Column, budget: int) -> DataFrame:
    """The ranked rows of each group up to the first that would exceed the budget."""
    w = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_sum", F.sum(size).over(w)).filter(F.col("_sum") <= budget).drop("_sum")


def first_seen(pools: DataFrame, by: list[str], limit: int) -> DataFrame:
    """pools(by, priority, rank, id): the union in order of priority and rank, the first of each id, at most limit."""
    once = pools.groupBy(*by, "id").agg(F.min(F.struct("priority", "rank")).alias("_f"))
    return ranked(once.select(*by, "id", F.col("_f.priority").alias("priority"), F.col("_f.rank").alias("pool_rank")), by, F.col("priority"), F.col("pool_rank"), F.col("id"), limit=limit)


def sigmoid(x: Column) -> Column:
    return F.when(x > 60, 1.0).when(x < -60, 0.0).otherwise(1 / (1 + F.exp(-x)))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two texts' words, the stand-in for a scoring model."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def scattered(pairs: DataFrame, scores: DataFrame, query: str, idx: str) -> DataFrame:
    """pairs(idx, query, ...) with the score that scores(query, idx, score) gives each place; 0 where it gives none."""
    return pairs.join(scores.select(query, idx, "score"), [query, idx], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def passage_stages(pool: DataFrame, by: list[str], scored: Column, reranked: int = 50, read: int = 8) -> DataFrame:
    """pool(by, id, rank) in its order: the first `reranked` candidates by scored, then id, with stage `read` for the first `read` and `rerank` for the others."""
    first = pool.filter(F.col("rank") <= reranked).drop("rank").withColumn("score", scored)
    out = ranked(first, by, F.desc("score"), F.col("id"))
    return out.withColumn("stage", F.when(F.col("rank") <= read, "read").otherwise("rerank"))
