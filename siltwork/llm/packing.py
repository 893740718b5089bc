"""Packing documents into sequences of at most `room` tokens.

Only lengths matter to a packing, and there are at most `room` of them, so the plan is made on the driver
from the histogram of lengths, whose size doesn't depend on the corpus. A plan is a list of runs: the
documents of one length with ranks from `rank` on go, one each, into the sequences from `sequence` on, at
the same offset. Each task numbers its own documents of a length, and a prefix sum over the tasks' counts makes these
numbers ranks, so no length is gathered anywhere, whatever its share of the rows.

best_fit_runs gives exactly the packing of the sequential best-fit-decreasing algorithm: sequences with
equal room left are interchangeable, so a whole class moves at once, and a segment tree over capacities
finds the smallest one that a length fits. pattern_runs first fits patterns of few documents that fill a
sequence exactly, by non-negative least squares against the histogram, and best fit packs the residual.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, free_name, materialised, need
from .tokens import load

ROOM = 2048
MOST_COUNTS = 1 << 20  # counts of pieces by length and task, of 20 bytes each, that are broadcast
HALF = 0.5  # documents; a pattern that descends by less is rounded away
Run = tuple[int, int, int, int, int]  # length, first rank, number, first sequence, offset


class CapacityTree:
    """Which capacities 0 to size - 1 occur; finds the smallest of at least a bound in log(size) steps."""

    def __init__(self, size: int):
        self.leaves = 1 << max(0, (size - 1).bit_length())
        self.any = np.zeros(2 * self.leaves, dtype=bool)

    def set(self, capacity: int, present: bool) -> None:
        i = self.leaves + capacity
        self.any[i] = present
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def least(self, bound: int) -> int | None:
        """The smallest present capacity >= bound."""
        i = self.leaves + bound
        if bound >= self.leaves:
            return None
        if self.any[i]:
            return bound
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:  # a right neighbour covers larger capacities
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit_runs(counts: np.ndarray, room: int, ranks: np.ndarray | None = None, sequence: int = 0) -> tuple[list[Run], int]:
    """Best-fit-decreasing over counts[length]; ranks: the first free rank of each length. Runs and the next free sequence."""
    ranks = np.zeros(room + 1, dtype=np.int64) if ranks is None else ranks
    tree = CapacityTree(room + 1)
    held: dict[int, deque] = defaultdict(deque)  # room left: intervals of sequences, first and number
    runs: list[Run] = []
    for length in range(room, 0, -1):
        left, rank = int(counts[length]), int(ranks[length])
        while left:
            capacity = tree.least(length)
            if capacity is None:  # new sequences, which differ from held ones only in that there are always more
                capacity, first, number = room, sequence, -(-left // (room // length))
                sequence += number
            else:
                first, number = held[capacity].popleft()
            # a sequence that takes one document of this length is then the best fit for the next until it is full
            each = capacity // length
            for use, inside in ((min(number, left // each), each), (1, left % each)):
                if not (use and inside and number):
                    continue
                for k in range(inside):
                    runs.append((length, rank, use, first, room - capacity + k * length))
                    rank, left = rank + use, left - use
                held[capacity - inside * length].append((first, use))
                tree.set(capacity - inside * length, True)
                first, number = first + use, number - use
            if number:
                held[capacity].appendleft((first, number))
            if not held[capacity]:
                tree.set(capacity, False)
        ranks[length] = rank
    return runs, sequence


def best_patterns(rest: np.ndarray, have: np.ndarray, room: int) -> list[tuple[int, int, int]]:
    """Of all patterns of one to three lengths that sum to room: for each length of some rest, that with the largest sum of rests, if it is HALF or more.

    Patterns are sorted, 0 for no document. Lengths that don't occur in have are in none.
    """
    rests = np.where(have, rest, -np.inf)
    rests[0] = 0.0
    found = []
    for a in np.flatnonzero(rests >= HALF / 3):
        pair = rests[: room - a + 1] + rests[room - a :: -1]  # b and room - a - b
        b = int(np.argmax(pair))
        if rests[a] + pair[b] >= HALF:
            found.append(tuple(sorted((int(a), b, int(room - a - b)))))
    return found


def fit_patterns(counts: np.ndarray, room: int, rounds: int = 20, sweeps: int = 4) -> dict[tuple[int, int, int], float]:
    """Non-negative least squares: repeats x >= 0 of patterns that bring the documents used, A x, near counts.

    An active set grows by the patterns with the steepest descent (best_patterns looks at all), and coordinate
    descent solves for it; patterns that fall to zero leave. It ends when no pattern descends by half a
    document. A few patterns of many repeats come out, some one for each length, so rounding keeps most.
    """
    rest = counts.astype(float)
    rest[0] = 0.0
    have = rest > 0
    x: dict[tuple[int, int, int], float] = {}
    entries: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    for _ in range(rounds):
        fresh = [p for p in best_patterns(rest, have, room) if p not in x]
        for p in fresh:
            x[p] = 0.0
            entries[p] = [(length, p.count(length)) for length in sorted(set(p)) if length]
        if not fresh:
            break
        for _ in range(sweeps):
            for p, old in x.items():
                step = sum(k * rest[length] for length, k in entries[p]) / sum(k * k for _, k in entries[p])
                now = max(0.0, old + step)
                if now != old:
                    x[p] = now
                    for length, k in entries[p]:
                        rest[length] -= k * (now - old)
        x = {p: v for p, v in x.items() if v > 1e-9}
    return x


def pattern_runs(counts: np.ndarray, room: int) -> tuple[list[Run], int]:
    """Runs of the fitted patterns, repeats rounded and cut to the documents there are, then of the best-fit-decreasing packing of what they leave.

    Patterns of few repeats use up short documents that would fill the gaps of the residual. Where that costs
    a sequence over the bound of a full packing, patterns of one, then of up to three and seven repeats join it.
    """
    counts = counts.astype(np.int64)
    counts[0] = 0
    fitted = sorted(fit_patterns(counts, room).items(), key=lambda p: (-p[1], p[0]))
    bound = -(-int(counts @ np.arange(room + 1)) // room)
    best: tuple[list[Run], int] | None = None
    for fewest in (1, 2, 4, 8):
        plan = _pattern_runs(fitted, counts.copy(), room, fewest)
        if best is None or plan[1] < best[1]:
            best = plan
        if best[1] == bound:
            break
    return best


def _pattern_runs(fitted: list[tuple[tuple[int, int, int], float]], counts: np.ndarray, room: int, fewest: int) -> tuple[list[Run], int]:
    ranks = np.zeros(room + 1, dtype=np.int64)
    runs: list[Run] = []
    sequence = 0
    for pattern, repeats in fitted:
        parts = [length for length in pattern if length]
        n = int(min(np.floor(repeats + 0.5), *(counts[length] // parts.count(length) for length in parts)))
        if n < fewest:
            continue
        offset = 0
        for length in reversed(parts):
            runs.append((length, int(ranks[length]), n, sequence, offset))
            ranks[length] += n
            counts[length] -= n
            offset += length
        sequence += n
    rest, sequence = best_fit_runs(counts, room, ranks, sequence)
    return runs + rest, sequence


def token_pieces(
    df: DataFrame, kind: str, path: str, end_id: int, room: int = ROOM, id_column: str = "doc_id",
    text_column: str = "text", pattern: str = "", with_ids: bool = True,
) -> DataFrame:
    """Each document's ids and end_id, cut losslessly into pieces of at most room.

    Columns: the id, piece, start, length, ids_crc32 of the little-endian unsigned 32-bit ids, part (the task that made the
    row), rank (of its pieces of that length, from 0), and with_ids
    the ids themselves as Zstandard-compressed little-endian bytes of the tokenizer's width, two thirds of
    their size in every shuffle and table that they pass through. A null text is an empty one, whose
    only id is end_id. A long text is a few megabytes of ids in one task, never more than its own.
    """
    need(df, id_column, text_column)
    id_type = df.schema[id_column].dataType
    source = df.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary").alias("t"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer, task, seen = load(kind, path, pattern), TaskContext.get().partitionId(), np.zeros(room + 1, dtype=np.int64)
        end = np.array([end_id], dtype=tokenizer.kind)
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            at, piece, start, length, crc, rank, ids = [], [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                found = np.concatenate([tokenizer.encode(text.as_py()), end])
                for k, s in enumerate(range(0, len(found), room)):
                    part = found[s : s + room]
                    at.append(i), piece.append(k), start.append(s), length.append(len(part)), rank.append(int(seen[len(part)]))
                    seen[len(part)] += 1
                    crc.append(zlib.crc32(part.astype("<u4").tobytes()))
                    if with_ids:
                        ids.append(compress(part.tobytes()))
                if len(ids) >= 2000:
                    yield rows(batch, task, at, piece, start, length, crc, rank, ids)
                    at, piece, start, length, crc, rank, ids = [], [], [], [], [], [], []
            yield rows(batch, task, at, piece, start, length, crc, rank, ids)

    def rows(batch, task, at, piece, start, length, crc, rank, ids) -> pa.RecordBatch:
        arrays = [
            batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
            pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([task] * len(at), pa.int32()), pa.array(rank, pa.int64()),
        ]
        names = ["id", "piece", "start", "length", "ids_crc32", "part", "rank"]
        if with_ids:
            arrays, names = [*arrays, pa.array(ids, pa.binary())], [*names, "ids"]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    shown = f"id {id_type.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids binary" * with_ids
    return arrow_map(source, cut, shown)


def placed(pieces: DataFrame, planner: Callable[[np.ndarray, int], tuple[list[Run], int]], room: int = ROOM) -> DataFrame:
    """pieces(length, part, rank, ...) with sequence_id and offset in place of part and rank, after the planner's runs.

    pieces must not change from one evaluation to the next; give a materialised table. Pieces of one length take places in the
    order of part and rank, so no row is shuffled where the counts of all parts can be broadcast.
    """
    sizes = pieces.groupBy(F.col("length").alias("l_"), F.col("part").alias("p_")).count()
    before = Window.partitionBy("l_").orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = materialised(sizes.withColumn("ahead_", F.coalesce(F.sum("count").over(before), F.lit(0))), "piece-counts")
    counts = np.zeros(room + 1, dtype=np.int64)
    for r in sizes.groupBy("l_").agg(F.sum("count").alias("n")).collect():  # at most room rows
        counts[r["l_"]] = r["n"]
    runs, _ = planner(counts, room)
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    shared = pieces.sparkSession.sparkContext.broadcast(table)  # bounded by room, not by rows

    sizes = sizes.drop("count")
    few = sizes.count() <= MOST_COUNTS  # beyond, Spark joins as it sees fit
    ranked = pieces.join(F.broadcast(sizes) if few else sizes, (F.col("length") == F.col("l_")) & (F.col("part") == F.col("p_")))
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("ahead_")).drop("l_", "p_", "ahead_", "part")
    names, rank = [c for c in ranked.columns if c != "rank"], "rank"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        keys = t[:, 0] << 44 | t[:, 1]
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            at = batch.column(batch.schema.get_field_index(rank)).to_numpy()
            run = np.searchsorted(keys, length << 44 | at, side="right") - 1
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            columns += [pa.array(t[run, 3] + at - t[run, 1], pa.int64()), pa.array(t[run, 4], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    kinds = dict(ranked.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", sequence_id long, offset long"
    return arrow_map(ranked, place, schema)


def best_fit_pack(df: DataFrame, kind: str, path: str, end_id: int, room: int = ROOM, **names) -> DataFrame:
    """Documents as pieces with their places, packed by fitted patterns and best fit for the rest.

    Columns: the id, piece, start, length, ids_crc32, sequence_id, offset. An id column that is called like one of the
    others gets underscores behind its name. Null texts are empty ones; rows with null or repeated ids are documents
    like others; an empty table gives an empty one.
    """
    pieces = materialised(token_pieces(df, kind, path, end_id, room, with_ids=False, **names), "pieces")
    out = placed(pieces, pattern_runs, room)
    return out.withColumnRenamed("id", free_name(out.drop("id"), names.get("id_column", "doc_id")))


def packed_matrices(df: DataFrame, kind: str, path: str, end_id: int, pad_id: int, room: int = ROOM, pattern: str = "", **names) -> DataFrame:
    """One row for each sequence: its ids as a row of a matrix, cumulative lengths and position resets.

    ids holds room little-endian ids of id_bytes bytes each, padded with pad_id; cu_seqlens are the
    cumulative segment lengths from 0 to n_tokens; position_resets are the offsets at which position ids
    start from 0 again: at each segment's begin, padding included. A piece of a cut document goes on at
    the position start of its document if a model wants that; starts has these. documents and pieces name
    the segments. Sequences are made by best-fit-decreasing over all pieces.
    """
    pieces = materialised(token_pieces(df, kind, path, end_id, room, pattern=pattern, **names), "id-pieces")
    slim = placed(pieces.drop("ids_crc32"), best_fit_runs, room)
    id_type = pieces.schema["id"].dataType.simpleString()
    ordered = slim.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    schema = (
        f"sequence_id long, n_tokens int, id_bytes int, ids binary, cu_seqlens array<int>, position_resets array<int>,"
        f" documents array<{id_type}>, pieces array<int>, starts array<long>"
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = load(kind, path, pattern).kind
        decompress = zstandard.ZstdDecompressor().decompress
        shape, done, held = None, [], []  # held: the segments of the sequence that is being read

        def close() -> None:
            ends = np.cumsum([0] + [r["length"] for r in held]).tolist()
            n = ends[-1]
            ids = b"".join(decompress(r["ids"]) for r in held) + np.full(room - n, pad_id, dtype=dtype).tobytes()
            resets = ends if n < room else ends[:-1]
            done.append((held[0]["sequence_id"], n, dtype.itemsize, ids, ends, resets, *([r[c] for r in held] for c in ("id", "piece", "start"))))
            held.clear()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), shape)], schema=shape)
            done.clear()
            return batch

        for batch in batches:
            shape = shape or pa.schema([
                ("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("id_bytes", pa.int32()), ("ids", pa.binary()),
                ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())),
                ("documents", pa.list_(batch.schema.field("id").type)), ("pieces", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())),
            ])
            for row in batch.to_pylist():
                if held and held[0]["sequence_id"] != row["sequence_id"]:
                    close()
                held.append(row)
            if len(done) >= 500:
                yield flush()
        if held:
            close()
        if done:
            yield flush()

    return arrow_map(ordered, build, schema)
