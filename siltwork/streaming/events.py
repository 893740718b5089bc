"""Polling, queues, rate limits and windows over event tables.

Each transform works on a batch DataFrame; those whose state Spark keeps itself (look-back dedup, window
counts, terminal states) work unchanged on a stream, with a watermark that bounds the state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """ts as a timestamp that watermarks accept."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def lookback_dedup(df: DataFrame, key: str, ts: str = "ts", hours: int = 96) -> DataFrame:
    """On a stream: the first event of a key within the look-back. On a batch: the earliest of each key in the last `hours`."""
    if df.isStreaming:
        return df.withWatermark(ts, f"{hours} hours").dropDuplicatesWithinWatermark([key])
    last = df.agg(F.max(ts).alias("_last"))
    recent = df.join(F.broadcast(last), F.col(ts) >= F.col("_last") - F.expr(f"interval {hours} hours")).drop("_last")  # one row
    w = Window.partitionBy(key).orderBy(ts)
    return recent.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def window_counts(df: DataFrame, size: str, slide: str | None = None, ts: str = "ts", *by: str) -> DataFrame:
    """Counts and sums of value by tumbling or sliding windows, late events up to one window allowed on a stream."""
    if df.isStreaming:
        df = df.withWatermark(ts, size)
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return df.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def session_counts(df: DataFrame, key: str, gap: str, ts: str = "ts") -> DataFrame:
    if df.isStreaming:
        df = df.withWatermark(ts, gap)
    return df.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))


def gaps(df: DataFrame, by: list[str], ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """df with gap, the seconds since the event before."""
    w = Window.partitionBy(*by).orderBy(ts, tie)
    return df.withColumn("gap", (F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(w)) / 1_000_000)


def next_daily(ts: Column, hour: int = 7) -> Column:
    """The next time at that hour, strictly later."""
    today = F.date_trunc("day", ts) + F.make_dt_interval(hours=F.lit(hour))
    return F.when(today > ts, today).otherwise(today + F.make_dt_interval(days=F.lit(1)))


STATES = {"signup": "queued", "click": "running", "view": "running", "purchase": "done", "error": "quarantined"}


def state_of(event: Column) -> Column:
    return F.create_map(*(F.lit(x) for p in STATES.items() for x in p))[event]


def queue_state(df: DataFrame, run: str, order: str) -> DataFrame:
    """The latest state of each run and, for queued ones, the place in first-in order.

    Queued runs are dealt out in ranges of their order; a place is the number of runs in the ranges before plus the
    place inside the range, so no task sees the whole queue.
    """
    latest = written(df.groupBy(run).agg(F.max_by(state_of(F.col("event_type")), F.col(order)).alias("state"), F.max(order).alias("at")), "runs")
    waiting = latest.filter("state = 'queued'").repartitionByRange("at").withColumn("_range", F.spark_partition_id())
    waiting = written(waiting.select(run, "at", "_range"), "queue")
    sizes = waiting.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("at"))
    placed = waiting.withColumn("_place", inside).join(before, "_range").select(run, (F.col("_place") + F.col("_before")).alias("position"))
    return latest.join(placed, run, "left")


def terminal_once(df: DataFrame, run: str, order: str) -> DataFrame:
    """The first terminal event of each run."""
    ended = df.filter(F.col("event_type").isin("purchase", "error"))
    if df.isStreaming:
        return ended.dropDuplicates([run])
    return ended.withColumn("_n", F.row_number().over(Window.partitionBy(run).orderBy(order))).filter("_n = 1").drop("_n")


def pacer(df: DataFrame, host: str, t: str, tie: str, delay: float) -> DataFrame:
    """Reserved times of a rate limiter: L_i = max(t_i, L_{i-1}) + delay and wait_i = max(0, L_{i-1} + delay - t_i), L before the first 0.

    Unrolled, L_i = delay (i + 1) + max over j <= i of (t_j - delay j), so one running maximum replaces the
    recurrence.
    """
    w = Window.partitionBy(host).orderBy(t, tie)
    i = F.row_number().over(w) - 1
    df = df.withColumn("_i", i)
    base = F.max(F.greatest(F.col(t), F.lit(0)) - delay * F.col("_i")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("slot", delay * (F.col("_i") + 1) + base)
    before = F.coalesce(F.lag("slot").over(w), F.lit(0.0))
    return df.withColumn("wait", F.greatest(F.lit(0.0), before + delay - F.col(t))).drop("_i")


def circuit_break(deaths: DataFrame, by: str, ts: str, window_s: int, threshold: int) -> DataFrame:
    """The first death of each group at which its trailing window holds the threshold: the breaker opens there for good."""
    w = Window.partitionBy(by).orderBy(F.col(ts).cast("timestamp").cast("long")).rangeBetween(-window_s, 0)
    counted = deaths.withColumn("in_window", F.count(F.lit(1)).over(w)).filter(F.col("in_window") >= threshold)
    return counted.groupBy(by).agg(F.min(ts).alias("opened"))


# The stages of a run in their order; the audit separates those before it from those behind it
STAGES = ("fetch", "parse_pipeline", "parse_vlm", "stage", "audit", "contextualize", "ingest")
BARRIER = "audit"


def select_stages(asked: Column, skipped: Column) -> Column:
    """struct(error, stages, before, after) of arrays of stage names, null for not given.

    `parse` stands for both parsers and `all` for every stage. Asking and skipping at once and unknown names are
    errors, which leave the rest null. Stages come in their own order; before and after are those on either
    side of the barrier.
    """
    every = F.array(*map(F.lit, STAGES))
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    full = lambda c: F.flatten(F.transform(c, lambda s: F.when(s == "parse", F.array(F.lit("parse_pipeline"), F.lit("parse_vlm"))).otherwise(F.array(s))))
    a, k = full(asked), full(skipped)
    whole = some(asked) & F.array_contains(a, "all")
    unknown = F.when(some(asked) & ~whole, F.size(F.array_except(a, every)) > 0).when(some(skipped), F.size(F.array_except(k, every)) > 0).otherwise(False)
    error = F.when(some(asked) & some(skipped), "exclusive").when(unknown, "unknown")
    chosen = F.when(whole, every).when(some(asked), F.filter(every, lambda s: F.array_contains(a, s))).when(some(skipped), F.filter(every, lambda s: ~F.array_contains(k, s))).otherwise(every)
    chosen = F.when(error.isNull(), chosen)
    at = STAGES.index(BARRIER)
    side = lambda names: F.array_intersect(chosen, F.array(*map(F.lit, names)))
    return F.struct(error.alias("error"), chosen.alias("stages"), side(STAGES[:at]).alias("before"), side(STAGES[at + 1 :]).alias("after"))
