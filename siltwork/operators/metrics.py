"""Retrieval quality and cost as DataFrame functions.

Ranked lists are rows (query_id, rank, id), references are rows (query_id, id). A query without references
has null metrics, a query whose references are all missed has 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at_k(ranked: DataFrame, refs: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """recall, mrr, hit and average precision at k for each query of `queries` (those of ranked by default).

    Lists are cut at k before equal ids are merged. One join and one aggregation, whatever the number of
    queries.
    """
    queries = (queries or ranked).select("query_id").distinct()
    total = refs.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n_ref"))
    top = ranked.filter(F.col("rank") <= k).join(refs.distinct().withColumn("_hit", F.lit(1)), ["query_id", "id"], "left")
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.coalesce("_hit", F.lit(0))
    top = top.withColumn("p", F.sum(hit).over(w) / F.count(F.lit(1)).over(w))
    found = top.groupBy("query_id").agg(
        F.countDistinct(F.when(hit == 1, F.col("id"))).alias("found"), F.min(F.when(hit == 1, F.col("rank"))).alias("first"), F.sum(F.col("p") * hit).alias("precisions"), F.sum(hit).alias("hits")
    )
    out = queries.join(total, "query_id", "left").join(found, "query_id", "left")
    known = F.col("n_ref").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        "query_id", F.when(known, zero(F.col("found") / F.col("n_ref"))).alias("recall"), F.when(known, zero(1 / F.col("first"))).alias("mrr"),
        F.when(known, F.col("first").isNotNull()).alias("hit"), F.when(known, zero(F.col("precisions") / (F.col("hits") + 1e-10))).alias("ap"),
    )


def mean_without_nan(c: Column) -> Column:
    """The mean of what is neither null (undefined) nor NaN (failed)."""
    return F.avg(F.when(~F.isnan(c), c))


# Prices in dollars a million tokens: model, cache miss, cache hit, output, reasoning
PRICES = (
    ("deepseek-v4-pro", 0.27, 0.054, 1.10, 1.10), ("deepseek-v4-flash", 0.14, 0.028, 0.28, 0.28), ("gemini-2.5-flash", 0.30, 0.075, 2.50, 2.50), ("gemini-3-flash-preview", 0.30, 0.075, 2.50, 2.50),
    ("gemini-3-pro-preview", 1.25, 0.31, 10.00, 10.00), ("gemini-3-flash-lite-preview", 0.10, 0.025, 0.40, 0.40), ("gemini-3.1-flash-lite-preview", 0.10, 0.025, 0.40, 0.40),
)


def usage_cost(usage: DataFrame, prices=PRICES) -> DataFrame:
    """usage(model, input, miss, hit, output, reasoning) with cost; null for an unknown model. Without a cache split all input is a miss."""
    r = F.broadcast(usage.sparkSession.createDataFrame(prices, "model string, r_miss double, r_hit double, r_out double, r_think double"))  # a price list
    split = F.col("miss") + F.col("hit") > 0
    miss, hit = F.when(split, F.col("miss")).otherwise(F.col("input")), F.when(split, F.col("hit")).otherwise(0)
    cost = (miss * F.col("r_miss") + hit * F.col("r_hit") + F.col("output") * F.col("r_out") + F.col("reasoning") * F.col("r_think")) / 1_000_000
    return usage.join(r, "model", "left").withColumn("cost", cost).drop("r_miss", "r_hit", "r_out", "r_think")


def majority(votes: DataFrame, key: str, vote: str, index: str) -> DataFrame:
    """The most frequent vote of each key; of ties the one seen first."""
    counts = votes.groupBy(key, vote).agg(F.count(F.lit(1)).alias("_n"), F.min(index).alias("_first"))
    w = Window.partitionBy(key).orderBy(F.desc("_n"), "_first")
    return counts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(key, vote, F.col("_n").alias("votes"))
