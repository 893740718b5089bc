"""Stateful streams: equal to the batch rule, also after a restart from the checkpoint."""

import random

import pytest
from pyspark.sql import functions as F

from siltwork.streaming import events as E
from siltwork.streaming import stateful as S


def run(spark, tmp_path, rows, schema, key, processor, timed=False, files=6, stop_after=3, prepare=lambda s: s):
    """The rows that a stream over `files` files gives, in two runs of one checkpoint: the second goes on where the first ended."""
    rows = sorted(rows, key=lambda r: (r[1], r[2]))
    source, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    size = -(-len(rows) // files)
    pieces = [rows[i : i + size] for i in range(0, len(rows), size)]
    for part in (pieces[:stop_after], pieces[stop_after:]):
        for piece in part:
            spark.createDataFrame(piece, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        if timed:
            stream = stream.withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long"))).withWatermark("ts", "0 seconds")
        found = S.with_state(prepare(stream), key, processor, timed)
        found.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return [tuple(r) for r in spark.read.parquet(out).collect()]


def test_slots_equal_the_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(5), float(rng.randrange(400)), i) for i in range(200)]
    schema = "host long, t double, event_id long"
    got = run(spark, tmp_path, rows, schema, "host", S.Slots(7.0))
    batch = E.pacer(spark.createDataFrame(rows, schema), "host", "t", "event_id", 7.0).select("event_id", "slot", "wait")
    assert sorted(got) == sorted(map(tuple, batch.collect()))


def test_ended_runs_are_a_bounded_set(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(40), float(i), i) for i in range(240)]
    got = run(spark, tmp_path, rows, "run long, t double, event_id long", "part", S.Ended(9), prepare=lambda s: s.withColumn("part", F.lit(0)))
    known, want = [], []
    for r, _, i in rows:
        if r not in known:
            want.append((r, i))
            known = [*known, r][-9:]
    assert sorted(got) == sorted(want) and len(want) > 40


def test_breaker_names_suspects_and_stays_open(spark, tmp_path):
    rng = random.Random(3)
    kinds = ["started"] * 5 + ["finished"] * 2 + ["died"] * 2 + ["respawn_failed"]
    rows = [(rng.randrange(6), float(t), t, rng.choice(kinds), f"s{rng.randrange(9)}") for t in range(300)]
    got = run(spark, tmp_path, rows, "daemon long, t double, event_id long, kind string, slug string", "daemon", S.Breaker(40.0, 4))
    want, state = [], {}
    for d, t, i, kind, slug in rows:
        s = state.setdefault(d, {"open": False, "deaths": [], "fly": set()})
        if s["open"]:
            continue
        if kind == "started":
            s["fly"].add(slug)
        elif kind == "finished":
            s["fly"].discard(slug)
        else:
            s["deaths"] = [x for x in s["deaths"] if x >= t - 40] + [t]
            s["open"] = len(s["deaths"]) >= 4
            want.append((d, i, len(s["deaths"]), min(s["fly"], default=None) if kind == "died" else None, s["open"]))
    key = lambda r: (r[0], r[1])
    assert sorted(got, key=key) == sorted(want, key=key) and any(w[4] for w in want) and any(w[3] for w in want)


def test_locks_are_taken_over_when_a_timer_fires(spark, tmp_path):
    rng = random.Random(4)
    rows, t = [], 0.0
    for i in range(240):
        t += rng.choice([5, 30, 60])
        rows.append((rng.randrange(8), t, i))
    rows += [(99, t + 5000.0, 999)]  # the watermark passes all others' times
    got = run(spark, tmp_path, rows, "lock long, t double, event_id long", "lock", S.Takeovers(300.0), timed=True)
    by = {}
    for lock, at, i in sorted(rows, key=lambda r: (r[1], r[2])):
        by.setdefault(lock, []).append((at, i))
    want = [(lock, i, at + 300) for lock, beats in by.items() for (at, i), nxt in zip(beats, [*beats[1:], (1e12, 0)]) if nxt[0] - at >= 300 and lock != 99]
    assert sorted(got) == sorted(want) and len(want) > 10


@pytest.mark.parametrize("parts", [None, 2])
def test_locks_of_a_part_run_out_one_by_one(spark, tmp_path, parts):
    """Parts give what locks of their own give, at the very time of the watermark too; a part whose locks all ran out begins anew."""
    beats = [(1, 1.0, 1), (2, 50.0, 2), (3, 100.0, 3), (4, 400.0, 4), (1, 410.0, 5), (4, 600.0, 6), (5, 710.0, 7), (4, 2000.0, 8), (6, 2300.0, 9)]
    key, prepare = ("part", lambda s: S.lock_parts(s, parts)) if parts else ("lock", lambda s: s)
    got = run(spark, tmp_path, beats, "lock long, t double, event_id long", key, S.Takeovers(300.0), timed=True, files=9, stop_after=5, prepare=prepare)
    assert sorted(got) == [(1, 1, 301.0), (1, 5, 710.0), (2, 2, 350.0), (3, 3, 400.0), (4, 6, 900.0), (4, 8, 2300.0), (5, 7, 1010.0)]


def test_takeovers_before_and_at_the_beginning_of_the_year(spark, tmp_path):
    """Rows at the watermark's own beginning aren't late, and a lock without a name is one."""
    import duckdb

    from siltwork.plans import registry

    registry.load()
    times = ["2023-12-20", "2023-12-25", "2024-01-01", "2024-01-02", "2024-01-03", "2024-01-07"]
    rows = [(i, times[i % 6], [1, 2, 1, None, 3, 1, 2][i % 7]) for i in range(24)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(registry.ORACLES["stream_takeovers"]).fetchall()
    got = [tuple(r) for r in registry.QUERIES["stream_takeovers"](spark, str(tmp_path)).collect()]
    key = lambda r: r[1]
    assert sorted(got, key=key) == sorted(want, key=key) and any(r[0] is None for r in want)


def test_state_is_called_for_parts_and_not_for_locks(spark, monkeypatch):
    """However many locks there are, the query has at most 1,024 keys."""
    from siltwork.plans import registry, streams
    from siltwork.plans.model import Tables

    registry.load()
    keys = []
    monkeypatch.setattr(streams, "_streamed", lambda t, rows, key, *a, **k: keys.append(rows.select(key).distinct().count()) or spark.createDataFrame([], S.Takeovers.OUTPUT))
    many = spark.range(20_000).selectExpr("id AS event_id", "id AS user_id", "timestamp_ntz'2024-01-02' AS ts")
    tables = Tables(spark, "none")
    tables.__dict__["events"] = many
    streams.stream_takeovers(tables)
    assert keys == [1024]


def test_queues_turn_runs_away_beyond_their_depth(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randrange(4), float(t), t, rng.choice(["enqueue", "enqueue", "start", "other"]), rng.randrange(12)) for t in range(240)]
    got = run(spark, tmp_path, rows, "queue long, t double, event_id long, kind string, run long", "queue", S.Queue(3))
    want, state = [], {}
    for q, _, i, kind, r in rows:
        w = state.setdefault(q, [])
        if kind == "enqueue":
            status = "duplicate" if r in w else "rejected" if len(w) == 3 else "queued"
            if status == "queued":
                w.append(r)
            want.append((q, i, r, status, len(w) if status == "queued" else None))
        elif kind == "start":
            want.append((q, i, w.pop(0), "running", None) if w else (q, i, None, "idle", None))
    key = lambda r: r[1]
    assert sorted(got, key=key) == want and {w[3] for w in want} == {"duplicate", "rejected", "queued", "running", "idle"}
