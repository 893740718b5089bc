"""Streams with state of their own: rate limits, ended runs, circuit breakers and stale locks.

Each is a processor of transformWithState, keyed so that Spark spreads the keys: state is in the state store, survives restarts from the
checkpoint and is bounded by what the rule needs. Rows of a key are taken in the order of time and id within a
micro-batch; the source must not bring a key's rows in a later batch before those of an earlier one, as files of a log don't.
Fed all rows at once, a stream gives what the batch form of the rule gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

NEVER = np.iinfo(np.int64).max
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """These processors need the state store that keeps several states a key."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def ordered(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: (r["t"], r["event_id"]))


class Slots(StatefulProcessor):
    """Of requests (host, t in seconds, event_id) the reserved times of a rate limiter; the state is a host's last one."""

    OUTPUT = "event_id long, slot double, wait double"

    def __init__(self, delay: float):
        self.delay = delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "slot double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = self.last.get()[0] if self.last.exists() else 0.0
        for r in ordered(rows):
            wait = max(0.0, last + self.delay - r["t"])
            last = max(r["t"], last) + self.delay
            yield Row(event_id=r["event_id"], slot=last, wait=wait)
        self.last.update((last,))

    def close(self) -> None:
        pass


class Ended(StatefulProcessor):
    """Of ended runs (part, run, t, event_id) the first report of each among the last `most` reported of its part."""

    OUTPUT = "run long, event_id long"

    def __init__(self, most: int = 4096):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")
        self.known = handle.getMapState("known", "run long", "n long")
        self.order = handle.getMapState("order", "n long", "run long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n = self.count.get()[0] if self.count.exists() else 0
        for r in ordered(rows):
            run = (r["run"],)
            if self.known.containsKey(run):
                continue
            self.known.updateValue(run, (n,))
            self.order.updateValue((n,), run)
            if n >= self.most:
                oldest = (n - self.most,)
                self.known.removeKey(tuple(self.order.getValue(oldest)))
                self.order.removeKey(oldest)
            n += 1
            yield Row(run=r["run"], event_id=r["event_id"])
        self.count.update((n,))

    def close(self) -> None:
        pass


class Breaker(StatefulProcessor):
    """Of a daemon's events (daemon, t, event_id, kind, slug) its deaths, with the suspect of each, until the breaker opens for good.

    started and finished say which slugs are in flight; died and respawn_failed are deaths, counted in the trailing window,
    both ends included. A death's suspect is the least slug in flight; a failed respawn has none. The death that reaches
    the threshold opens the breaker, and nothing counts behind it.
    """

    OUTPUT = "daemon long, event_id long, deaths int, suspect string, opened boolean"

    def __init__(self, window: float, threshold: int):
        self.window, self.threshold = window, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "open boolean")
        self.deaths = handle.getListState("deaths", "t double")
        self.flying = handle.getMapState("flying", "slug string", "t double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.open.exists():
            return
        deaths = [d[0] for d in self.deaths.get()] if self.deaths.exists() else []
        for r in ordered(rows):
            slug = (r["slug"],)
            if r["kind"] == "started":
                self.flying.updateValue(slug, (r["t"],))
            elif r["kind"] == "finished":
                self.flying.removeKey(slug)
            elif r["kind"] in ("died", "respawn_failed"):
                deaths = [t for t in deaths if t >= r["t"] - self.window] + [r["t"]]
                slugs = [k[0] for k in self.flying.keys()] if r["kind"] == "died" else []
                opened = len(deaths) >= self.threshold
                yield Row(daemon=key[0], event_id=r["event_id"], deaths=len(deaths), suspect=min(slugs, default=None), opened=opened)
                if opened:
                    self.open.update((True,))
                    self.deaths.clear()
                    self.flying.clear()
                    return
        self.deaths.put([(t,) for t in deaths]) if deaths else self.deaths.clear()

    def close(self) -> None:
        pass


class Takeovers(StatefulProcessor):
    """Of heartbeats (lock, t, event_id) the times at which a lock is taken over: `timeout` seconds behind a last heartbeat.

    Keyed by lock, or by part of the locks (lock_parts): calls of the state and batches of output are made for a key, not for a lock. The state is
    the last heartbeat of each lock. A timer of the event's time waits for the key's first lock to run out, so an idle lock is taken over once
    the watermark has passed that time, without another row. A heartbeat after a takeover holds the lock anew.
    """

    OUTPUT = "lock long, event_id long, at double"
    FRAMES = True  # rows come and go as pandas frames

    def __init__(self, timeout: float = 300.0, epoch: int = 0):
        self.timeout, self.epoch = timeout, epoch  # epoch: seconds of 1970 at which t is 0, as in the stream's watermark

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", "lock long, t double, event_id long")

    def _expired(self, beats: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lock": beats["lock"], "event_id": beats["event_id"], "at": beats["t"] + self.timeout})

    def _due(self, beats: pd.DataFrame) -> np.ndarray:
        """Timers in ms: one fires once the watermark is above it, which is when it has reached the beat's time and timeout."""
        return -(-np.rint((beats["t"].to_numpy() + self.timeout) * 1e6).astype(np.int64) // 1000) - 1 + self.epoch * 1000

    def _held(self) -> pd.DataFrame:
        return self._frame(pd.DataFrame(list(self.last.get()) if self.last.exists() else [], columns=["lock", "t", "event_id"]))

    @staticmethod
    def _frame(beats: pd.DataFrame) -> pd.DataFrame:
        return beats[["lock", "t", "event_id"]].astype({"lock": "Int64", "t": "float64", "event_id": "Int64"})

    def _keep(self, beats: pd.DataFrame) -> None:
        columns = (beats[c].astype(object).where(beats[c].notna(), None).tolist() for c in ("lock", "t", "event_id"))
        self.last.put(list(zip(*columns)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        every = pd.concat([held, *map(self._frame, rows)], ignore_index=True)
        every = every.assign(n=pd.factorize(every["lock"], use_na_sentinel=False)[0], new=every.index >= len(held)).sort_values(["n", "new", "t", "event_id"])
        last = every["n"].to_numpy() != every["n"].shift(-1, fill_value=-1).to_numpy()
        yield self._expired(every[~last & (every["t"].shift(-1) - every["t"] >= self.timeout).to_numpy()])
        before, every = self._due(held).min(initial=NEVER), every[last]
        self._keep(every)
        first = self._due(every).min()
        if first != before:
            if before != NEVER:
                self.handle.deleteTimer(int(before))
            self.handle.registerTimer(int(first))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        due = self._due(held)
        over = (due <= expiredTimerInfo.getExpiryTimeInMs()) | (due < timerValues.getCurrentWatermarkInMs())
        yield self._expired(held[over])
        if over.all():
            self.last.clear()
        elif over.any():
            self._keep(held[~over])
            self.handle.registerTimer(int(due[~over].min()))

    def close(self) -> None:
        pass


class Queue(StatefulProcessor):
    """Of a queue's events (queue, t, event_id, kind, run) what became of each: a first-in first-out queue of at most `depth` waiting runs.

    enqueue puts a run behind the others, and gives its place, or rejects it where depth runs wait, or where it waits already. start takes the
    run that has waited longest; without one it is idle. The state is the waiting runs, so it is bounded by depth.
    """

    OUTPUT = "queue long, event_id long, run long, status string, position int"

    def __init__(self, depth: int):
        self.depth = depth

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "run long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        waiting = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        for r in ordered(rows):
            run, status, position = r["run"], None, None
            if r["kind"] == "enqueue":
                status = "duplicate" if run in waiting else "rejected" if len(waiting) >= self.depth else "queued"
                if status == "queued":
                    waiting.append(run)
                    position = len(waiting)
            elif r["kind"] == "start":
                status, run = ("running", waiting.pop(0)) if waiting else ("idle", None)
            if status:
                yield Row(queue=key[0], event_id=r["event_id"], run=run, status=status, position=position)
        self.waiting.put([(w,) for w in waiting]) if waiting else self.waiting.clear()

    def close(self) -> None:
        pass


def with_state(stream: DataFrame, key: str, processor: StatefulProcessor, timed: bool = False) -> DataFrame:
    """The processor's rows; timed ones need a stream with a watermark."""
    use_state_store(stream.sparkSession)
    mode = "eventTime" if timed else "none"
    grouped = stream.groupBy(key)
    run = grouped.transformWithStateInPandas if getattr(processor, "FRAMES", False) else grouped.transformWithState
    return run(processor, processor.OUTPUT, "append", mode)


def ended_parts(stream: DataFrame, parts: int) -> DataFrame:
    """stream(run, ...) with part, by which the set of ended runs is cut."""
    return stream.withColumn("part", F.pmod(F.xxhash64("run"), F.lit(parts)).cast("int"))


def lock_parts(stream: DataFrame, parts: int) -> DataFrame:
    """stream(lock, ...) with part, by which the set of locks is cut."""
    return stream.withColumn("part", F.pmod(F.xxhash64("lock"), F.lit(parts)).cast("int"))
