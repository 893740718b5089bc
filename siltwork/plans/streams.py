"""Streams: each transform in batch, and as a stream over the same rows where Spark keeps its state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder
from ..streaming import events as E
from ..streaming import stateful as S
from .registry import query

C = F.col
YEAR = 1704067200  # seconds of 1970 at which 2024 begins


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 96 HOUR) WHERE n = 1""")
def lookback_dedup(t) -> DataFrame:
    return E.lookback_dedup(E.event_time(t.events), "user_id").select("user_id", "event_id")


@query("SELECT date_trunc('day', ts)::DATE AS day, count(*) AS found, count_if(event_type = 'purchase') AS ingested, count_if(event_type <> 'purchase') AS skipped FROM events GROUP BY 1")
def poll_runs(t) -> DataFrame:
    done = C("event_type") == "purchase"
    rows = t.events.groupBy(F.to_date("ts").alias("day"))
    return rows.agg(F.count(F.lit(1)).alias("found"), F.count_if(done).alias("ingested"), F.count_if(~done).alias("skipped"))


@query("""WITH g AS (SELECT event_id, user_id, ts, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) / 1e6 AS gap FROM events)
SELECT event_id, coalesce(gap < 21600, false) AS skipped, CASE WHEN date_trunc('day', ts) + INTERVAL 7 HOUR > ts THEN date_trunc('day', ts) + INTERVAL 7 HOUR ELSE date_trunc('day', ts) + INTERVAL 31 HOUR END AS next FROM g""")
def schedule_gap(t) -> DataFrame:
    """A poll is skipped if the last one is less than six hours ago; the next comes at seven."""
    rows = E.gaps(t.events, ["user_id"])
    return rows.select("event_id", F.coalesce(C("gap") < 21600, F.lit(False)).alias("skipped"), E.next_daily(C("ts").cast("timestamp")).cast("timestamp_ntz").alias("next"))


STATE = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'quarantined' END"
LATEST = f"l AS (SELECT user_id, arg_max({STATE}, event_id) AS state, max(event_id) AS at_ FROM events GROUP BY user_id)"


@query(f"WITH {LATEST} SELECT user_id, state, CASE WHEN state = 'queued' THEN row_number() OVER (PARTITION BY state ORDER BY at_) END AS position FROM l")
def queue_state(t) -> DataFrame:
    return E.queue_state(t.events, "user_id", "event_id").select("user_id", "state", "position")


@query(f"WITH {LATEST} SELECT user_id, CASE WHEN state = 'running' AND user_id % 2 = 0 THEN 'crashed' ELSE state END AS state FROM l")
def queue_reconcile(t) -> DataFrame:
    """Runs that are said to run but whose process is gone have crashed."""
    alive = C("user_id") % 2 == 1
    return E.queue_state(t.events, "user_id", "event_id").select("user_id", F.when((C("state") == "running") & ~alive, "crashed").otherwise(C("state")).alias("state"))


@query(f"WITH {LATEST} SELECT DISTINCT user_id + 1 AS user_id FROM l WHERE user_id + 1 NOT IN (SELECT user_id FROM l WHERE state IN ('queued', 'running'))")
def dedup_enqueue(t) -> DataFrame:
    """Requests without one pending."""
    state = E.queue_state(t.events, "user_id", "event_id")
    return state.select((C("user_id") + 1).alias("user_id")).distinct().join(state.filter("state in ('queued', 'running')"), "user_id", "left_anti")


@query("SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id")
def terminal_once(t) -> DataFrame:
    return E.terminal_once(t.events, "user_id", "event_id").select("user_id", "event_id")


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 - 1704067200 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
s AS (SELECT *, 3600.0::DOUBLE * (i + 1) + max(greatest(t, 0) - 3600.0::DOUBLE * i) OVER (PARTITION BY user_id ORDER BY i) AS slot FROM e)
SELECT event_id, round(slot, 3) AS slot, round(greatest(0, coalesce(lag(slot) OVER (PARTITION BY user_id ORDER BY i), 0) + 3600 - t), 3) AS wait FROM s""")
def pacer_slots(t) -> DataFrame:
    """Seconds of 2024, one request an hour."""
    rows = t.events.select("event_id", "user_id", (F.unix_micros(C("ts").cast("timestamp")) / 1_000_000 - 1704067200).alias("t"))
    return E.pacer(rows, "user_id", "t", "event_id", 3600.0).select("event_id", F.round("slot", 3).alias("slot"), F.round("wait", 3).alias("wait"))


@query("SELECT user_id, count_if(event_type = 'signup') AS fetched, count_if(event_type = 'click') AS parsed, count_if(event_type = 'error') AS failed, count_if(event_type = 'signup') <= count_if(event_type IN ('purchase', 'error')) AS finished FROM events GROUP BY user_id")
def run_fold(t) -> DataFrame:
    n = lambda *k: F.count_if(C("event_type").isin(*k))
    return t.events.groupBy("user_id").agg(n("signup").alias("fetched"), n("click").alias("parsed"), n("error").alias("failed"), (n("signup") <= n("purchase", "error")).alias("finished"))


@query("""WITH c AS (SELECT user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 864000 PRECEDING AND CURRENT ROW) AS n FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events WHERE event_type = 'error'))
SELECT user_id, min(ts) AS opened FROM c WHERE n >= 2 GROUP BY user_id""")
def circuit_break(t) -> DataFrame:
    deaths = t.events.filter("event_type = 'error'").select("user_id", F.date_trunc("second", C("ts").cast("timestamp")).alias("ts"))
    return E.circuit_break(deaths, "user_id", "ts", 864000, 2).select("user_id", C("opened").cast("timestamp_ntz").alias("opened"))


@query("SELECT event_id, coalesce(date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) / 1e6 >= 300, false) AS stale FROM events")
def stale_lock(t) -> DataFrame:
    """A heartbeat that comes 300 seconds or more after the one before finds its lock taken over."""
    return E.gaps(t.events, ["user_id"]).select("event_id", F.coalesce(C("gap") >= 300, F.lit(False)).alias("stale"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(t) -> DataFrame:
    rows = E.window_counts(E.event_time(t.events), "1 day", None, "ts", "event_type")
    return rows.select(C("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT s AS start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT value, unnest([time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY s""")
def sliding_counts(t) -> DataFrame:
    rows = E.window_counts(E.event_time(t.events), "12 hours", "6 hours")
    return rows.select(C("w.start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, event_id, (coalesce(ts - lag(ts) OVER w >= INTERVAL 12 HOUR, true))::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid""")
def session_counts(t) -> DataFrame:
    rows = E.session_counts(E.event_time(t.events), "user_id", "12 hours")
    return rows.select("user_id", C("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id")
def stream_terminal_counts(t) -> DataFrame:
    """A stateful stream run to its end over the events: the same rows as a batch."""
    top = shared_folder(t.spark, "stream")
    t.events.select("user_id", "event_type").repartition(3).write.parquet(f"{top}/in")
    stream = t.spark.readStream.schema("user_id long, event_type string").option("maxFilesPerTrigger", 2).parquet(f"{top}/in")
    counts = stream.filter(C("event_type").isin("purchase", "error")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{top}/out/b={number}")

    counts.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
    rows = t.spark.read.option("recursiveFileLookup", "true").parquet(f"{top}/out")
    w = Window.partitionBy("user_id").orderBy(F.desc("batch"))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("user_id", "n")


def _streamed(t, rows: DataFrame, key: str, processor, timed: bool = False) -> DataFrame:
    """What a stateful stream gives of rows(t, ...): the earlier half first, then, from its checkpoint, the later one."""
    top, half = shared_folder(t.spark, "stateful"), rows.agg(((F.min("t") + F.max("t")) / 2).alias("half")).first()["half"] or 0.0
    for part in (C("t") < half, C("t") >= half):
        rows.filter(part).write.mode("append").parquet(f"{top}/in")
        stream = t.spark.readStream.schema(rows.schema).parquet(f"{top}/in")
        if timed:
            stream = stream.withColumn("ts", F.timestamp_micros(F.round(C("t") * 1_000_000).cast("long") + YEAR * 1_000_000)).withWatermark("ts", "0 seconds")
        found = S.with_state(stream, key, processor, timed)
        found.writeStream.outputMode("append").format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{top}/out")


def _seconds(t) -> DataFrame:
    """Events with t, seconds of 2024."""
    return t.events.withColumn("t", (F.unix_micros(C("ts").cast("timestamp")) / 1_000_000 - 1704067200))


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 - 1704067200 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
s AS (SELECT *, 3600.0::DOUBLE * (i + 1) + max(greatest(t, 0) - 3600.0::DOUBLE * i) OVER (PARTITION BY user_id ORDER BY i) AS slot FROM e)
SELECT event_id, round(slot, 3) AS slot, round(greatest(0, coalesce(lag(slot) OVER (PARTITION BY user_id ORDER BY i), 0) + 3600 - t), 3) AS wait FROM s""")
def stream_slots(t) -> DataFrame:
    """The rate limiter as a stream with the last reserved time of each user as its state."""
    rows = _streamed(t, _seconds(t).select(C("user_id").alias("host"), "t", "event_id"), "host", S.Slots(3600.0))
    return rows.select("event_id", F.round("slot", 3).alias("slot"), F.round("wait", 3).alias("wait"))


@query("SELECT user_id AS run, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id")
def stream_ended(t) -> DataFrame:
    """Each run's first end, of a set of 4096 runs for each of 64 parts, which holds all of these."""
    ended = _seconds(t).filter(C("event_type").isin("purchase", "error")).select(C("user_id").alias("run"), "t", "event_id")
    return _streamed(t, S.ended_parts(ended, 64), "part", S.Ended())


@query("""WITH e AS (SELECT user_id AS d, event_id, epoch_us(ts) / 1e6 - 1704067200 AS t, 's' || (event_id % 7) AS slug,
  CASE event_type WHEN 'view' THEN 'finished' WHEN 'error' THEN 'died' WHEN 'purchase' THEN 'respawn_failed' ELSE 'started' END AS kind FROM events),
x AS (SELECT * FROM e WHERE kind IN ('died', 'respawn_failed')),
n AS (SELECT a.d, a.event_id, a.t, a.kind, count(*)::INT AS deaths FROM x a JOIN x b ON a.d = b.d AND b.t >= a.t - 1728000 AND (b.t, b.event_id) <= (a.t, a.event_id) GROUP BY ALL),
o AS (SELECT d, min((t, event_id)) AS first FROM n WHERE deaths >= 4 GROUP BY d),
l AS (SELECT n.d, n.event_id, e.slug, arg_max(e.kind, (e.t, e.event_id)) AS last FROM n JOIN e ON n.d = e.d AND e.kind IN ('started', 'finished') AND (e.t, e.event_id) < (n.t, n.event_id) GROUP BY ALL),
s AS (SELECT d, event_id, min(slug) AS suspect FROM l WHERE last = 'started' GROUP BY ALL)
SELECT n.d AS daemon, n.event_id, deaths, CASE WHEN kind = 'died' THEN suspect END AS suspect, deaths >= 4 AS opened
FROM n LEFT JOIN o USING (d) LEFT JOIN s ON s.d = n.d AND s.event_id = n.event_id WHERE first IS NULL OR (t, n.event_id) <= first""")
def stream_breaker(t) -> DataFrame:
    """Deaths of each user's daemon with their suspects, until the fourth within twenty days opens its breaker."""
    kind = F.when(C("event_type") == "view", "finished").when(C("event_type") == "error", "died").when(C("event_type") == "purchase", "respawn_failed").otherwise("started")
    rows = _seconds(t).select(C("user_id").alias("daemon"), "t", "event_id", kind.alias("kind"), F.concat(F.lit("s"), C("event_id") % 7).alias("slug"))
    return _streamed(t, rows, "daemon", S.Breaker(1728000.0, 4))


@query("""WITH e AS (SELECT user_id AS lock, event_id, epoch_us(ts) / 1e6 - 1704067200 AS t FROM events),
n AS (SELECT *, lead(t) OVER (PARTITION BY lock ORDER BY t, event_id) AS next, max(t) OVER () AS seen FROM e)
SELECT lock, event_id, round(t + 172800, 3) AS at FROM n WHERE CASE WHEN next IS NULL THEN t + 172800 <= seen ELSE next - t >= 172800 END""")
def stream_takeovers(t) -> DataFrame:
    """Locks taken over when two days pass without a heartbeat, by timers of the event's time; the locks lie in 1,024 parts."""
    beats = S.lock_parts(_seconds(t).select(C("user_id").alias("lock"), "t", "event_id"), 1024)
    rows = _streamed(t, beats, "part", S.Takeovers(172800.0, YEAR), timed=True)
    return rows.select("lock", "event_id", F.round("at", 3).alias("at"))


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id % 20 AS queue, event_id, user_id AS run, CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'click' THEN 'enqueue' WHEN 'view' THEN 'start' END AS kind,
  row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS i FROM events WHERE event_type IN ('signup', 'click', 'view')),
s AS (SELECT DISTINCT queue, 0::BIGINT AS i, []::BIGINT[] AS w, NULL::BIGINT AS event_id, NULL::BIGINT AS run, NULL::VARCHAR AS status, NULL::INT AS position FROM e
  UNION ALL
  SELECT s.queue, e.i, CASE WHEN kind = 'start' THEN s.w[2:] WHEN list_contains(s.w, e.run) OR len(s.w) >= 3 THEN s.w ELSE list_append(s.w, e.run) END, e.event_id,
    CASE WHEN kind = 'start' THEN s.w[1] ELSE e.run END,
    CASE WHEN kind = 'start' THEN CASE WHEN len(s.w) > 0 THEN 'running' ELSE 'idle' END WHEN list_contains(s.w, e.run) THEN 'duplicate' WHEN len(s.w) >= 3 THEN 'rejected' ELSE 'queued' END,
    CASE WHEN kind = 'enqueue' AND NOT list_contains(s.w, e.run) AND len(s.w) < 3 THEN (len(s.w) + 1)::INT END
  FROM s JOIN e ON s.queue = e.queue AND e.i = s.i + 1)
SELECT queue, event_id, run, status, position FROM s WHERE i > 0""")
def stream_queue(t) -> DataFrame:
    """Queues that take at most three waiting runs and turn others away."""
    kind = F.when(C("event_type").isin("signup", "click"), "enqueue").when(C("event_type") == "view", "start")
    rows = _seconds(t).select((C("user_id") % 20).alias("queue"), "t", "event_id", kind.alias("kind"), C("user_id").alias("run")).filter("kind is not null")
    return _streamed(t, rows, "queue", S.Queue(3))


ASKED = "CASE event_id % 6 WHEN 0 THEN ['parse', 'fetch'] WHEN 1 THEN ['all'] WHEN 2 THEN ['ingest', 'audit', 'stage'] WHEN 3 THEN ['no_such'] END"
SKIPPED = "CASE event_id % 4 WHEN 0 THEN ['parse'] WHEN 3 THEN ['fetch', 'ingest'] END"
ALL = "['fetch', 'parse_pipeline', 'parse_vlm', 'stage', 'audit', 'contextualize', 'ingest']"


@query(f"""WITH r AS (SELECT event_id, {ASKED} AS a0, {SKIPPED} AS k0 FROM events),
e AS (SELECT event_id, a0, k0, flatten(list_transform(a0, lambda s: CASE WHEN s = 'parse' THEN ['parse_pipeline', 'parse_vlm'] ELSE [s] END)) AS a, flatten(list_transform(k0, lambda s: CASE WHEN s = 'parse' THEN ['parse_pipeline', 'parse_vlm'] ELSE [s] END)) AS k FROM r),
c AS (SELECT event_id, CASE WHEN a0 IS NOT NULL AND k0 IS NOT NULL THEN 'exclusive' WHEN a0 IS NOT NULL AND NOT list_contains(a, 'all') AND NOT list_has_all({ALL}, a) THEN 'unknown' END AS error,
  CASE WHEN list_contains(a, 'all') THEN {ALL} WHEN a0 IS NOT NULL THEN list_filter({ALL}, lambda s: list_contains(a, s)) WHEN k0 IS NOT NULL THEN list_filter({ALL}, lambda s: NOT list_contains(k, s)) ELSE {ALL} END AS st FROM e)
SELECT event_id, error, CASE WHEN error IS NULL THEN array_to_string(st, ',') END AS stages, CASE WHEN error IS NULL THEN array_to_string(list_filter(st, lambda s: list_contains({ALL}[1:4], s)), ',') END AS before,
  CASE WHEN error IS NULL THEN array_to_string(list_filter(st, lambda s: list_contains({ALL}[6:7], s)), ',') END AS after FROM c""")
def select_stages(t) -> DataFrame:
    """Stages asked for or skipped, in order, on both sides of the barrier."""
    six, four = C("event_id") % 6, C("event_id") % 4
    names = lambda *n: F.array(*map(F.lit, n))
    asked = F.when(six == 0, names("parse", "fetch")).when(six == 1, names("all")).when(six == 2, names("ingest", "audit", "stage")).when(six == 3, names("no_such"))
    skipped = F.when(four == 0, names("parse")).when(four == 3, names("fetch", "ingest"))
    rows = t.events.select("event_id", E.select_stages(asked, skipped).alias("s"))
    return rows.select("event_id", "s.error", *(F.array_join(C("s")[c], ",").alias(c) for c in ("stages", "before", "after")))
