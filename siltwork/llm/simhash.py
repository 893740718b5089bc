"""SimHash near-duplicate detection with pigeonhole blocks.

Exact form (linked): 64-bit fingerprints link at `radius` or fewer differing bits. A fingerprint is cut into
`blocks` blocks; close ones agree in at least blocks - radius of them, so each choice of that many blocks
is a bucket key that all close pairs share. Buckets are streamed in sorted order and each yields a spanning
forest of its links, never its pairs, so a bucket of m members costs at most m - 1 rows. A bucket with more
than BUCKET members is keyed again by the bits that its members don't share yet, which bounds what a task
holds and loses no link.

Similarity form (grouped): a longer fingerprint, whose share of differing bits estimates the angle between
two sets of shingles and, with their sizes, the Jaccard similarity. Pairs meet in blocks; those whose marks are near and
whose Hamming distance says `similarity` - ROUGH or more are decided by the Jaccard similarity of their
shingle hashes. A block is as wide as keeps an average bucket below AVERAGE members, whatever the number of
texts, and there are as many as find a pair at the similarity with the same chance: 24 bits and 170 blocks up to 5 * 10^8
texts, 28 bits and 328 blocks up to 8 * 10^9. With p differing bits in a hundred a pair shares one of 170 blocks with probability
1 - (1 - (1 - p/100)^24)^170: 0.96 at a similarity of 0.8, 0.998 at 0.85 and more above. Blocks are searched
in rounds; what a round links counts as one member from then on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, free_name, materialised, need
from .components import components

BUCKET = 1 << 16  # members that a task links at once
SEED = 42


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included, A-Z lower-cased, words space-joined."""
    parts = text.lower().split()  # on bytes: A-Z only, and \x20 \x09-\x0D only
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)
    starts = np.concatenate([[0], ends[: -words]])
    slices = map(joined.__getitem__, map(slice, starts.tolist(), (ends[words - 1 :] - 1).tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, slices, repeat(SEED)), dtype=np.uint64, count=len(starts))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    total = np.zeros(64, dtype=np.int64)
    for s in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[s : s + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3) -> DataFrame:
    """id and fp, the fingerprint as a signed long. Null text is empty text, whose fingerprint is 0."""
    need(df, id_column, text_column)
    source = df.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([majority(shingle_hashes(t.as_py(), words)) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return arrow_map(source, run, f"id {source.dtypes[0][1]}, fp long")


def masks(free: list[int], blocks: int, radius: int) -> list[int]:
    """For each choice of blocks - radius blocks of the free bit positions, the mask of their bits."""
    cut = [free[i * len(free) // blocks : (i + 1) * len(free) // blocks] for i in range(blocks)]
    return [sum(1 << bit for block in chosen for bit in block) for chosen in combinations(cut, blocks - radius)]


def forest(fp: np.ndarray, free: list[int], blocks: int, radius: int, small: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect distinct fingerprints, which differ in free bits only, as far as all links within radius do."""
    if len(fp) < 2:
        return
    if len(free) <= radius:
        yield np.full(len(fp) - 1, fp[0]), fp[1:]
        return
    if len(fp) <= small or len(free) < 2 * blocks:
        left = fp
        while len(left):
            front, left = [left[0]], left[1:]
            while front and len(left):
                at = front.pop()
                near = np.bitwise_count(left ^ at) <= radius
                found, left = left[near], left[~near]
                if len(found):
                    yield np.full(len(found), at), found
                    front.extend(found)
        return
    for mask in masks(free, blocks, radius):
        key = fp & np.uint64(mask)
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        for part in np.split(fp[order], cuts):
            yield from forest(part, [b for b in free if not mask >> b & 1], blocks, radius, small)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _bucket_links(rows: DataFrame, level_masks: list[int], blocks: int, radius: int, last: bool) -> DataFrame:
    """rows(mask, key, fp) as links (a, b); of a bucket that is too large, rows (a, null) with its mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 3), dtype=np.int64)
        over: tuple[int, int] | None = None  # the bucket that is passed on

        def out(a, b, mask) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b, pa.array(mask, pa.int64())], names=["a", "b", "mask"])

        def link(table: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.flatnonzero(np.any(table[1:, :2] != table[:-1, :2], axis=1)) + 1
            starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(table)]])
            fp = np.ascontiguousarray(table[:, 2]).view(np.uint64)
            a, b = [], []
            two = starts[ends - starts == 2]
            close = np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius
            a.append(fp[two[close]]), b.append(fp[two[close] + 1])
            for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
                mask = int(table[s, 0]) & (1 << 64) - 1
                for x, y in forest(fp[s:e], [i for i in range(64) if not mask >> i & 1], blocks, radius):
                    a.append(x), b.append(y)
            a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            if len(a):
                yield out(a, pa.array(b, pa.int64()), np.zeros(len(a), dtype=np.int64))

        for batch in batches:
            table = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            if over is not None:
                same = (table[:, 0] == over[0]) & (table[:, 1] == over[1])
                if same.any():
                    yield out(table[same, 2], pa.nulls(same.sum(), pa.int64()), table[same, 0])
                    table = table[~same]
                if len(table):
                    over = None
            if not len(table):
                continue
            table = np.concatenate([held, table])
            others = np.flatnonzero(np.any(table[:, :2] != table[-1, :2], axis=1))
            begin = int(others[-1]) + 1 if len(others) else 0
            if begin:
                yield from link(table[:begin])
            held = table[begin:]
            if len(held) > BUCKET and not last:
                over = (int(held[0, 0]), int(held[0, 1]))
                yield out(held[:, 2], pa.nulls(len(held), pa.int64()), held[:, 0])
                held = held[:0]
        if len(held):
            yield from link(held)

    ordered = rows.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
    return arrow_map(ordered, run, "a long, b long, mask long")


def links(fps: DataFrame, blocks: int = 6, radius: int = 3) -> DataFrame:
    """Links a, b that connect distinct fingerprints fp exactly as all pairs within radius would."""
    first = masks(list(range(64)), blocks, radius)

    def keyed(df: DataFrame, each) -> DataFrame:
        return df.select("fp", F.explode(each).alias("mask")).select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp")

    level = F.array(*(F.lit(_signed(m)) for m in first))
    found = materialised(_bucket_links(keyed(fps, level), first, blocks, radius, False), "links")
    large = found.filter(F.col("b").isNull())
    done = found.filter(F.col("b").isNotNull()).select("a", "b")
    if large.limit(1).count():
        finer = {m: [m | n for n in masks([i for i in range(64) if not m >> i & 1], blocks, radius)] for m in first}
        second = F.create_map(*(x for m, more in finer.items() for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(n)) for n in more)))))
        rows = keyed(large.select(F.col("a").alias("fp"), "mask"), second[F.col("mask")])
        again = _bucket_links(rows.distinct(), [], blocks, radius, True)  # 2 ** 16 members at most
        done = done.union(materialised(again, "links").select("a", "b"))
    return done


def linked(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3, blocks: int = 6, radius: int = 3) -> DataFrame:
    """One row for each row of df: id, fingerprint (16 hex digits) and component_id.

    component_id is the smallest id that links reach from the row's fingerprint, its own included; rows
    with null ids take part but lend no id. Empty and null texts have fingerprint 0 and link like others.
    """
    marks = materialised(fingerprints(df, id_column, text_column, words), "fingerprints")
    distinct = materialised(marks.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    of = components(links(distinct.select("fp"), blocks, radius)).withColumnRenamed("node", "fp")
    groups = distinct.join(of, "fp", "left").withColumn("group", F.coalesce("component", "fp"))
    ids = groups.groupBy("group").agg(F.min("least").alias("component_id"))
    known = groups.select("fp", "group").join(ids, "group").select("fp", "component_id")
    rows = marks.join(known, "fp")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.select(F.col("id").alias(id_column), digits.alias("fingerprint"), "component_id")


# --- similarity form ---

WIDE = 4096  # bits of a transform
AVERAGE = 32  # members of an average bucket at most
LEAST_WIDTH = 24  # bits of a block
CHANCE = 3.29  # expected number of blocks that a pair at the similarity shares: it shares none with probability exp(-CHANCE)
MARK = 16  # bytes of a fingerprint, its last ones, that travel with a block's value
FAR = 40  # differing bits of a mark beyond which two members aren't looked at: five standard deviations from a similarity of 0.8
MEETING = 1 << 14  # members that a task compares at once
SHINGLES = 1 << 23  # and their shingles
ROUGH = 0.05  # how far below the similarity an estimate may be of pairs that are looked at
SLOTS = 1 << 22  # of a filter of nodes, which bounds what is broadcast
ROUNDS = (1, 3, 12, 48)  # blocks searched in each round; the last round takes the others
_H = np.array([[1.0 if (i & j).bit_count() % 2 == 0 else -1.0 for j in range(64)] for i in range(64)], dtype=np.float32)


@dataclass(frozen=True)
class Shape:
    """Bits of a block, number of blocks, bits of a fingerprint."""

    width: int
    blocks: int
    wide: int


def shape(texts: int, similarity: float = 0.8) -> Shape:
    """Blocks so wide that `texts` fingerprints make buckets of AVERAGE members at most, and so many that CHANCE holds."""
    width = max(LEAST_WIDTH, 4 * math.ceil(math.log2(max(1, texts) / AVERAGE) / 4))
    agree = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi  # of a bit
    blocks = math.ceil(CHANCE / agree**width)
    return Shape(width, blocks, WIDE * -(-blocks * width // WIDE))


def wide_bits(counts: np.ndarray, wide: int = WIDE) -> np.ndarray:
    """Signs of `wide` pseudo-random projections of each row, packed: two Hadamard transforms with sign flips for each WIDE."""
    out = []
    for g in range(wide // WIDE):
        x = counts.astype(np.float32)
        for flip in np.random.default_rng(5 + g).choice(np.array([-1.0, 1.0], dtype=np.float32), size=(2, WIDE)):
            x = (_H @ (x * flip).reshape(-1, 64, 64) @ _H).reshape(-1, WIDE) / 64
        out.append(np.packbits(x > 0, axis=1))
    return np.concatenate(out, axis=1)


def wide_fingerprints(df: DataFrame, id_column: str, text_column: str, words: int, wide: int = WIDE) -> DataFrame:
    """id, node (a hash of the shingle set), n (distinct shingles, at least 1), bits (wide / 8 bytes), part (a hash of the text) and the set's sorted hashes."""
    need(df, id_column, text_column)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    source = df.select(F.col(id_column).alias("id"), text.cast("binary").alias("t"), F.xxhash64(text).alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                counts, sizes, sets = np.zeros((batch.num_rows, WIDE), dtype=np.float32), [], []
                for i, t in enumerate(batch.column(1)):
                    h = np.unique(shingle_hashes(t.as_py(), words))
                    sizes.append(max(1, len(h)))
                    sets.append(h.tobytes())
                    sign = (h >> np.uint64(12) & np.uint64(1)).astype(np.float32) * 2 - 1
                    counts[i] = np.bincount((h & np.uint64(WIDE - 1)).astype(np.int64), sign, WIDE)
                bits = [b.tobytes() for b in wide_bits(counts, wide)]
                node = np.array([xxhash.xxh64_intdigest(s) for s in sets], dtype=np.uint64).view(np.int64)
                columns = [batch.column(0), pa.array(node), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), batch.column(2), pa.array(sets, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "node", "n", "bits", "part", "shingles"])

    return arrow_map(source, run, f"id {source.dtypes[0][1]}, node long, n long, bits binary, part long, shingles binary")


def jaccard(distance: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, wide: int = WIDE) -> np.ndarray:
    """The similarity of two sets of n_a and n_b shingles at a Hamming distance."""
    shared = np.cos(np.pi * distance / wide) * np.sqrt(n_a * n_b)
    return shared / np.maximum(n_a + n_b - shared, 1e-9)


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets of hashes have the Jaccard similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= similarity * (len(a) + len(b) - shared) - 1e-9


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def block_keys(piece: np.ndarray, first: int, width: int = LEAST_WIDTH, skip: int = 0) -> np.ndarray:
    """Rows of bytes, from bit `skip` on, as rows of values of blocks, the block's number, from first on, above them."""
    bits = np.unpackbits(piece, axis=1)[:, skip:]
    count = bits.shape[1] // width
    cut = np.packbits(bits[:, : count * width].reshape(len(piece), count, width), axis=2).astype(np.int64)
    size = cut.shape[2]
    return cut @ (1 << 8 * np.arange(size, dtype=np.int64)) | np.arange(first, first + count, dtype=np.int64) << 8 * size


def _near(mark: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether marks, rows of two words without the byte of the number of shingles, are near."""
    return np.bitwise_count(mark ^ other).sum(axis=-1, dtype=np.int64) <= FAR


def grouped(marks: DataFrame, similarity: float = 0.8, form: Shape | None = None) -> DataFrame:
    """(node, grp) of the nodes of marks (materialised wide_fingerprints) that links tie to a smaller node, grp the smallest.

    Blocks are searched in rounds of ROUNDS blocks, and what a round links is contracted before the next one
    looks: a bucket whose members are of one group gives nothing, one of g groups at most g - 1 links between
    groups. So a family of m documents costs some m rows and not its pairs.
    """
    form = form or shape(0, similarity)
    nodes = marks.groupBy("node").agg(F.first("bits").alias("bits"), F.max("n").alias("n"))
    # two different sets, the smaller one of n shingles, are n / (n + 1) similar at most
    nodes = materialised(nodes.filter(F.col("n") >= F.lit(float(similarity)) * (F.col("n") + 1) - 1e-9), "nodes")
    groups, start = None, 0
    for step in (*ROUNDS, form.blocks):
        blocks = range(start, min(start + step, form.blocks))
        start = blocks.stop
        if not blocks:
            break
        members = materialised(_dealt(_keyed(nodes, groups, blocks, form)), "members")
        before = groups
        groups = _contracted(groups, _linked(marks, members, similarity, form, False))
        large = members.filter("part is not null")
        if large.limit(1).count():  # so far each part has met the first one only
            now = groups.toDF("g_node", "now")
            large = large.join(now, F.col("node") == F.col("g_node"), "left").withColumn("grp", F.coalesce("now", "node")).select(members.columns)
            left = materialised(_dealt(_left(large)), "members")
            after = _contracted(groups, _linked(marks, left, similarity, form, True))
            discard(left)
            discard(groups)
            groups = after
        discard(members)
        if before is not None:
            discard(before)
    discard(nodes)
    return groups


def _contracted(groups: DataFrame | None, edges: DataFrame) -> DataFrame:
    """groups after edges (a, b) between groups, written."""
    of = components(edges)
    new = of.filter("node <> component").toDF("node", "grp")
    if groups is not None:
        of = of.toDF("o_node", "component")
        old = groups.join(of, F.col("grp") == F.col("o_node"), "left").select("node", F.coalesce("component", "grp").alias("grp"))
        new = old.union(new)  # a group's smallest node is in neither before it is tied to a smaller one
    return materialised(new, "groups")


def _keyed(nodes: DataFrame, groups: DataFrame | None, blocks: range, form: Shape) -> DataFrame:
    """key, node, grp, mark0, mark1 of each node in each block."""
    begin, end = blocks.start * form.width // 8, -(-blocks.stop * form.width // 8)
    skip = blocks.start * form.width - 8 * begin
    source = nodes.select("node", F.substring("bits", begin + 1, end - begin).alias("piece"), F.substring("bits", form.wide // 8 - MARK + 1, MARK).alias("mark"), "n")
    if groups is None:
        source = source.withColumn("grp", F.col("node"))
    else:
        source = source.join(groups.toDF("g_node", "grp"), F.col("node") == F.col("g_node"), "left").select("node", "piece", "mark", "n", F.coalesce("grp", "node").alias("grp"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                k = block_keys(_bytes(part.column(1), end - begin), blocks.start, form.width, skip)
                mark = _bytes(part.column(2), MARK).copy()
                mark[:, -1] = np.ceil(8 * np.log2(part.column(3).to_numpy()))  # the last byte says the number of shingles
                mark = mark.view(np.int64)
                columns = [part.column(0).to_numpy(), part.column(4).to_numpy(), mark[:, 0], mark[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), *(pa.array(np.repeat(c, k.shape[1])) for c in columns)], names=["key", "node", "grp", "mark0", "mark1"])

    return arrow_map(source, keys, "key long, node long, grp long, mark0 long, mark1 long")


NO_COUNT = np.array([~np.uint64(0), np.uint64((1 << 56) - 1)])


def _near_another_group(table: np.ndarray) -> np.ndarray:
    """Which rows (key, node, grp, mark0, mark1), sorted by key, have one of another group in their bucket whose mark is near."""
    new = np.flatnonzero(np.diff(table[:, 0])) + 1
    starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(table)]])
    apart = np.minimum.reduceat(table[:, 2], starts) != np.maximum.reduceat(table[:, 2], starts)
    end = np.repeat(ends, ends - starts)
    mark = np.ascontiguousarray(table[:, 3:]).view(np.uint64) & NO_COUNT
    keep = np.zeros(len(table), dtype=bool)
    at = np.flatnonzero(np.repeat(apart, ends - starts))
    for d in range(1, int((ends - starts).max())):
        at = at[at + d < end[at]]
        if not len(at):
            break
        near = _near(mark[at], mark[at + d]) & (table[at, 2] != table[at + d, 2])
        keep[at[near]] = keep[at[near] + d] = True
    return keep


def _dealt(keyed: DataFrame) -> DataFrame:
    """key, part, node, grp, mark0, mark1 of the members of buckets of several groups.

    Members whose marks are far from those of all other groups in their bucket are left out. part is null but in
    a bucket that is too large for one task; two parts of it together have MEETING members and SHINGLES
    shingles at most, or a part has one member.
    """

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 5), dtype=np.int64)
        over, before = None, 0.0  # the key of a bucket of several parts, and the weight of what it has given

        def weight(table: np.ndarray) -> np.ndarray:
            n = 2.0 ** (np.ascontiguousarray(table[:, 4:]).view(np.uint8)[:, -1] / 8)
            return np.maximum(n * 2 / SHINGLES, 2 / MEETING)

        def out(table: np.ndarray, part: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(table[:, 0]), part, *(pa.array(table[:, c]) for c in range(1, 5))], names=["key", "part", "node", "grp", "mark0", "mark1"])

        def parts(table: np.ndarray, before: float) -> pa.RecordBatch:
            w = weight(table)
            return out(table, pa.array((before + np.cumsum(w) - w).astype(np.int64)))

        def several(table: np.ndarray) -> pa.RecordBatch:
            keep = _near_another_group(table)
            return out(table[keep], pa.nulls(int(keep.sum()), pa.int64()))

        for batch in batches:
            table = np.concatenate([held, np.stack([batch.column(i).to_numpy() for i in range(5)], axis=1)])
            held = held[:0]
            if over is not None:
                cut = int(np.searchsorted(table[:, 0], over, side="right"))
                if cut:
                    yield parts(table[:cut], before)
                    before += weight(table[:cut]).sum()
                table = table[cut:]
            if not len(table):
                continue
            over, begin = None, int(np.searchsorted(table[:, 0], table[-1, 0]))
            if begin:
                yield several(table[:begin])
            held = table[begin:]
            if len(held) > 2 and weight(held).sum() > 1:
                over, before = int(held[0, 0]), weight(held).sum()
                yield parts(held, 0.0)
                held = held[:0]
        if len(held):
            yield several(held)

    return arrow_map(keyed.repartition("key").sortWithinPartitions("key"), meeting, "key long, part long, node long, grp long, mark0 long, mark1 long")


def _meetings(large: DataFrame, all_parts: bool) -> DataFrame:
    """Members of buckets of several parts and groups, once for each part they meet: the first one, or with all_parts each other."""
    several = large.groupBy(F.col("key").alias("s_key")).agg(F.max("part").alias("last"), (F.min("grp") != F.max("grp")).alias("apart")).filter("apart")
    others = F.expr("filter(sequence(0L, greatest(last, 1L)), x -> x <> part)") if all_parts else F.expr("if(part > 0, array(0L), sequence(1L, greatest(last, 1L)))")
    rows = large.join(several, F.col("key") == F.col("s_key")).withColumn("with", F.explode(others))
    return rows.select("key", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), "node", "grp", "mark0", "mark1")


def _left(large: DataFrame) -> DataFrame:
    """Of large buckets, what any two parts leave of each other by their marks; rows of five numbers meet, no fingerprints."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 7), dtype=np.int64)

        def end(table: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = [0, *(np.flatnonzero(np.any(table[1:, :3] != table[:-1, :3], axis=1)) + 1).tolist(), len(table)]
            for s, e in zip(cut, cut[1:]):
                if s < e:
                    own = table[s:e][:, [0, 3, 4, 5, 6]]
                    own = own[_near_another_group(own)]
                    yield pa.RecordBatch.from_arrays([pa.array(own[:, c]) for c in range(5)], names=["key", "node", "grp", "mark0", "mark1"])

        for batch in batches:
            table = np.concatenate([held, np.stack([batch.column(i).to_numpy() for i in range(7)], axis=1)])
            if not len(table):
                continue
            others = np.flatnonzero(np.any(table[:, :3] != table[-1, :3], axis=1))
            begin = int(others[-1]) + 1 if len(others) else 0
            yield from end(table[:begin])
            held = table[begin:]
        yield from end(held)

    meet = _meetings(large, True).repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return arrow_map(meet, test, "key long, node long, grp long, mark0 long, mark1 long").distinct()


def _linked(marks: DataFrame, members: DataFrame, similarity: float, form: Shape, all_parts: bool) -> DataFrame:
    """Links (a, b) between groups, a the smaller, that connect a bucket's groups as all its similar pairs would.

    Parts of a large bucket meet the first one, or with all_parts each other.
    """

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows (key, low, high, grp, bits, n, shingles), sorted by the first three."""
        held: list[pa.RecordBatch] = []

        def end() -> Iterator[pa.RecordBatch]:
            group = np.concatenate([h.column(3).to_numpy() for h in held])
            n = np.concatenate([h.column(5).to_numpy() for h in held]).astype(float)
            bits = np.concatenate([_bytes(h.column(4), form.wide // 8) for h in held]).view(np.uint64)
            mark = bits[:, -2:] & NO_COUNT
            sets = [np.frombuffer(s.as_buffer(), dtype=np.uint64) for h in held for s in h.column(6)]
            held.clear()
            left = np.arange(len(group))
            a, b = [], []
            while len(left):
                mine, front, left = {int(group[left[0]])}, [left[group[left] == group[left[0]]]], left[group[left] != group[left[0]]]
                while front and len(left):
                    at, front = front[0][0], [front[0][1:], *front[1:]] if len(front[0]) > 1 else front[1:]
                    distance = np.bitwise_count(bits[left] ^ bits[at]).sum(axis=1, dtype=np.int64)
                    found: set[int] = set()
                    for i in left[_near(mark[left], mark[at]) & (jaccard(distance, n[left], n[at], form.wide) >= similarity - ROUGH)]:
                        if int(group[i]) not in found and alike(sets[at], sets[i], similarity):
                            found.add(int(group[i]))
                    if found:
                        near = np.isin(group[left], list(found))
                        front.append(left[near])
                        left = left[~near]
                        mine |= found
                least = min(mine)
                mine.discard(least)
                a += [least] * len(mine)
                b += mine
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            key = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1).tolist(), batch.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                if held and any(held[-1].column(i)[0].as_py() != key[s, i] for i in range(3)):
                    yield from end()
                held.append(batch.slice(s, e - s))
        if held:
            yield from end()

    large = _meetings(members.filter("part is not null"), all_parts).drop("mark0", "mark1")
    zero = F.lit(0).cast("long")
    meet = members.filter("part is null").select("key", zero.alias("low"), zero.alias("high"), "node", "grp").union(large)
    # what the members at hand hold: a filter of fixed size keeps most others out of the shuffle
    slot = F.pmod(F.col("node"), F.lit(SLOTS)).cast("int")
    slots = members.select(slot.alias("slot")).distinct()
    held = marks.select("node", "bits", "n", "shingles").join(F.broadcast(slots), slot == F.col("slot"), "left_semi")
    held = held.groupBy("node").agg(*(F.first(c).alias(c) for c in ("bits", "n", "shingles")))
    rows = meet.join(held, "node").select("key", "low", "high", "grp", "bits", "n", "shingles")
    return arrow_map(rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high"), within, "a long, b long")


def near_dedup(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of df with one of each group of near duplicates, that with the smallest id (null last), then text hash.

    Groups are connected by links of at least the similarity between sets of word shingle hashes. Texts without
    words are alike. Rows with equal id and text count as one document and stay together: remove exact
    copies first. Columns are those of df.
    """
    form = shape(df.count(), similarity)
    marks = materialised(wide_fingerprints(df, id_column, text_column, words, form.wide), "wide-fingerprints")
    groups = grouped(marks, similarity, form)
    of = groups.toDF("g_node", "grp")
    rows = marks.select("id", "part", "node").join(of, F.col("node") == F.col("g_node"), "left")
    rows = rows.withColumn("group", F.coalesce("grp", "node"))
    best = F.min(F.struct(F.col("id").isNull(), "id", "part")).alias("best")
    keepers = rows.groupBy("group").agg(best, F.count(F.lit(1)).alias("rows")).filter("rows > 1").withColumnRenamed("group", "k_group")
    gone = rows.join(keepers, F.col("group") == F.col("k_group")).filter(
        ~(F.col("id").eqNullSafe(F.col("best.id")) & (F.col("part") == F.col("best.part")))
    )
    i, p = free_name(df, "gone_id_"), free_name(df, "gone_part_")
    gone = materialised(gone.select(F.col("id").alias(i), F.col("part").alias(p)).distinct(), "near-copies")
    discard(marks)
    discard(groups)
    part = F.xxhash64(F.coalesce(F.col(text_column).cast("string"), F.lit("")))
    return df.join(gone, F.col(id_column).eqNullSafe(F.col(i)) & (part == F.col(p)), "left_anti")
