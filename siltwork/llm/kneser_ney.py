"""Language model scores: interpolated modified Kneser-Ney n-grams, counted in Spark, mapped by workers.

Tokens are words, A-Z lower-cased, and one end for each text. The model is a set of sorted arrays, cut into
shards by the leading bits of their keys: the vocabulary (hashes of words; a word's id is its place), for each
length the n-grams (hashes of ids) with their counts, and their contexts with what follows them. The longest n-grams
have the counts of the corpus, shorter ones the number of different tokens before them, or their own count at a
text's begin. Three discounts a length come from the counts of counts.

Tasks count their own n-grams first and send them on by shard as compressed columns; the task of a shard adds
them up, writes its array and sends contexts and shorter n-grams on. A shard has some SHARD entries, whatever the
size of the corpus, and a hot n-gram is one entry of each task. Nothing is left out, and the driver sees only sizes
and counts of counts.

Workers map the arrays' files, so what a task touches is read once for all workers of a machine and nothing is held. The
model's folder must therefore be on a file system that every worker has mounted; by default it is in spark.checkpoint.dir.

Defined results: null texts are empty, they have one token, the end; null ids count as the empty text in the choice of
training rows. A token that training hasn't seen has the share of the uniform part. Without training rows every token
has probability 1, for there is only the unknown one. Long texts are read in slices, with the context carried over.
"""

from __future__ import annotations

import os
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, materialised, need, new_folder

ORDER = 2
HELD_OUT = 1  # remainder of the id's CRC-32 by 5 that isn't learned from
SHARD = 1 << 21  # entries of an array's file
CHUNK = 1 << 21  # n-grams that a task counts before it sends them on
TOKENS = 1 << 18  # tokens looked up together
SLICE = 1 << 22  # bytes of a text read at once
WORDS = 300_000  # of a worker's cache
BEGIN, END = b" <", b" >"  # no word holds white space
UNKNOWN, BEGIN_ID, FIRST = 0, 1, 2
BLOCK = "kind string, shard int, data binary"


def held_out(id_column: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 5 == HELD_OUT


def word_hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word, 42)
    return h - (1 << 64) if h >> 63 else h


def mixed(*columns: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of ids."""
    h = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        h += c.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def shard_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.int64(64 - bits)) + (1 << bits - 1) if bits else np.zeros(len(h), dtype=np.int64)


def bits_for(entries: int) -> int:
    return max(0, (-(-entries // SHARD) - 1).bit_length())


# --- arrays ---


@lru_cache(4096)
def _mapped(path: str) -> np.ndarray:
    return np.load(path, mmap_mode="r")


def local_path(folder: str) -> str:
    """The folder as workers open it."""
    if "://" in folder and not folder.startswith("file://"):
        raise RuntimeError(f"workers map the model's files: give a folder that all have mounted, not {folder}")
    return folder.removeprefix("file://").removeprefix("file:")


def save(folder: str, name: str, shard: int, columns: dict[str, np.ndarray]) -> None:
    """A shard's columns; a repeated task writes the same file again, whole."""
    os.makedirs(folder, exist_ok=True)
    for column, values in columns.items():
        own = f"{folder}/{uuid.uuid4().hex}.tmp"
        with open(own, "wb") as f:
            np.save(f, values)
        os.replace(own, f"{folder}/{name}-{shard}-{column}.npy")


@dataclass
class Arrays:
    """Sorted keys in shards, with columns of values."""

    folder: str
    name: str
    bits: int

    def find(self, keys: np.ndarray, *columns: str) -> list[np.ndarray]:
        """For sorted keys the values of each column, 0 for keys that aren't there; place is that in the shard."""
        out = [np.zeros(len(keys), dtype=np.int64) for _ in columns]
        shards = shard_of(keys, self.bits)
        for shard in np.unique(shards):
            path = f"{self.folder}/{self.name}-{shard}-"
            if not os.path.exists(path + "key.npy"):
                continue
            have, at = _mapped(path + "key.npy"), np.flatnonzero(shards == shard)
            place = np.minimum(np.searchsorted(have, keys[at]), len(have) - 1)
            hit = have[place] == keys[at]
            for o, column in zip(out, columns):
                o[at[hit]] = place[hit] if column == "place" else _mapped(f"{path}{column}.npy")[place[hit]]
        return out


def small(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint32) if not len(values) or values.max() < 1 << 32 else values.astype(np.uint64)


def summed(h: np.ndarray, carried: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Distinct hashes in order, what each carries, and the sums of its values."""
    order = np.argsort(h, kind="stable")
    h = h[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
    first = order[starts]
    sums = [np.add.reduceat(v[order], starts) if len(starts) else v[:0] for v in values]
    return h[starts], [c[first] for c in carried], sums


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of one length as compressed bytes."""
    parts = [np.array([len(columns), len(columns[0])], dtype=np.int64).tobytes()]
    for c in columns:
        c = c if c.dtype == np.int64 else small(c)
        parts.append({"int64": b"i", "uint32": b"u", "uint64": b"w"}[c.dtype.name] + c.tobytes())
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    count, rows = np.frombuffer(raw, dtype=np.int64, count=2).tolist()
    out, at = [], 16
    for _ in range(count):
        kind = np.dtype({b"i": np.int64, b"u": np.uint32, b"w": np.uint64}[raw[at : at + 1]])
        out.append(np.frombuffer(raw, dtype=kind, count=rows, offset=at + 1))
        at += 1 + rows * kind.itemsize
    return out


def _blocks(kind: str, bits: int, h: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of h as one block for each shard."""
    shards = shard_of(h, bits)
    cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(h)]
    for s, e in zip(cuts, cuts[1:]):
        if s < e:
            yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([int(shards[s])], pa.int32()), pa.array([pack([c[s:e] for c in columns])], pa.binary())], names=["kind", "shard", "data"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns of each shard, of blocks sorted by shard."""
    shard, held = -1, []
    for batch in batches:
        for s, data in zip(batch.column(1).to_pylist(), batch.column(2)):
            if s != shard and held:
                yield shard, [np.concatenate(c) for c in zip(*held)]
                held = []
            shard = s
            held.append(unpack(data.as_py()))
    if held:
        yield shard, [np.concatenate(c) for c in zip(*held)]


def _by_shard(blocks: DataFrame, bits: int) -> DataFrame:
    return blocks.repartition(1 << bits, "shard").sortWithinPartitions("shard")


# --- tokens ---


def slices(text: bytes) -> Iterator[tuple[list[bytes], bool]]:
    """The words of a text, slice after slice, and whether these are the last."""
    at = 0
    while len(text) - at > SLICE:
        end = max(text.rfind(c, at, at + SLICE) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if end <= at:  # a word that is longer than a slice
            found = [i for i in (text.find(c, at + SLICE) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if i >= 0]
            if not found:
                break
            end = min(found)
        yield text[at:end].lower().split(), False
        at = end
    yield text[at:].lower().split(), True


def runs(texts: list[bytes], order: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Tokens of many texts, which of them count (the others are contexts), and the number of each one's text."""
    words, begins, owners = [], [], []

    def out():
        counts = np.ones(len(words), dtype=bool)
        for b in begins:
            counts[b : b + order - 1] = False
        return words, counts, np.repeat(np.array(owners), np.diff([*begins, len(words)]))

    for i, text in enumerate(texts):
        before = [BEGIN] * (order - 1)
        for some, last in slices(text):
            begins.append(len(words))
            owners.append(i)
            words += before
            words += some
            if last:
                words.append(END)
            before = words[len(words) - order + 1 :]
            if len(words) >= TOKENS:
                yield out()
                words, begins, owners = [], [], []
    if words:
        yield out()


class Vocabulary:
    """Ids of words and their counts in training, by a cache before the mapped arrays."""

    def __init__(self, arrays: Arrays, offsets: list[int]):
        self.arrays, self.offsets = arrays, np.array(offsets, dtype=np.int64)
        self._clear()

    def _clear(self) -> None:
        self.slots = {BEGIN: 0}
        self.ids, self.counts = np.array([BEGIN_ID], dtype=np.int64), np.zeros(1, dtype=np.int64)

    def _look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        h = np.fromiter(map(word_hash, words), dtype=np.int64, count=len(words))
        order = np.argsort(h)
        place, count = self.arrays.find(h[order], "place", "count")
        ids = np.where(count > 0, place + self.offsets[shard_of(h[order], self.arrays.bits)] + FIRST, UNKNOWN)
        out = np.zeros((2, len(words)), dtype=np.int64)
        out[0][order], out[1][order] = ids, count
        return out[0], out[1]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and training counts."""
        slots = np.fromiter(map(self.slots.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            if len(self.slots) > WORDS:
                self._clear()
                return self.encode(words)
            new = list(dict.fromkeys(map(words.__getitem__, missing.tolist())))
            begin = len(self.slots)
            self.slots.update(zip(new, range(begin, begin + len(new))))
            ids, counts = self._look_up(new)
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
            slots[missing] = np.fromiter(map(self.slots.__getitem__, map(words.__getitem__, missing.tolist())), dtype=np.int64, count=len(missing))
        return self.ids[slots], self.counts[slots]


@dataclass
class Model:
    """Where the arrays are, and the few numbers that all scores need."""

    order: int
    folder: str
    vocabulary_bits: int
    offsets: list[int]
    tokens: int
    words: int
    gram_bits: int = 0
    #: for each length from 1 on: discounts of counts of 1, 2 and 3 or more
    discounts: list[tuple[float, float, float]] = field(default_factory=list)
    #: of the single tokens: sum of their counts, and how many count 1, 2 and 3 or more
    singles: tuple[int, int, int, int] = (0, 0, 0, 0)

    def vocabulary(self) -> Vocabulary:
        return Vocabulary(Arrays(self.folder, "word", self.vocabulary_bits), self.offsets)

    def arrays(self, name: str) -> Arrays:
        return Arrays(self.folder, name, self.gram_bits)

    def _discounted(self, length: int, count: np.ndarray) -> np.ndarray:
        return np.maximum(count - np.array([0.0, *self.discounts[length - 1]])[np.minimum(count, 3)], 0)

    def probabilities(self, windows: list[np.ndarray]) -> np.ndarray:
        """Of the last column's tokens, each after the other columns of its row."""
        _, first, inverse = np.unique(mixed(*windows), return_index=True, return_inverse=True)
        ids = [w[first] for w in windows]
        p = np.full(len(first), 1 / (self.words + 1))
        for length in range(1, self.order + 1):
            d1, d2, d3 = self.discounts[length - 1]
            count = self._found(f"gram{length}", ids[self.order - length :], "count")[0]
            if length == 1:
                total, *more = (np.full(len(p), x) for x in self.singles)
            else:
                total, *more = self._found(f"context{length}", ids[self.order - length : -1], "total", "one", "two", "more")
            some = total > 0
            below = (d1 * more[0] + d2 * more[1] + d3 * more[2]) / np.maximum(total, 1)
            p = np.where(some, self._discounted(length, count) / np.maximum(total, 1) + below * p, p)
        return p[inverse]

    def _found(self, name: str, ids: list[np.ndarray], *columns: str) -> list[np.ndarray]:
        keys, inverse = np.unique(mixed(*ids), return_inverse=True)
        return [c[inverse] for c in self.arrays(name).find(keys, *columns)]


def windows(ids: np.ndarray, counts: np.ndarray, order: int) -> list[np.ndarray]:
    """The columns of the n-grams that end at the tokens that count."""
    at = np.flatnonzero(counts)
    return [ids[at - back] for back in range(order - 1, -1, -1)]


# --- counting ---


def _word_counts(source: DataFrame) -> DataFrame:
    """key, count: the training tokens' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            keys, values = list(map(word_hash, found)), list(found.values())
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.int64())], names=["key", "count"])

        for batch in batches:
            for text in batch.column(1):
                for words, last in slices(text.as_py()):
                    found.update(words)
                    if last:
                        found[END] += 1
                    if len(found) > WORDS:
                        yield out()
        if found:
            yield out()

    return arrow_map(source, run, "key long, count long").groupBy("key").agg(F.sum("count").alias("count"))


def _save_words(words: DataFrame, folder: str, bits: int) -> list[int]:
    """Writes the vocabulary's arrays; the number of words before each shard."""
    shard = F.shiftright("key", 64 - bits) + (1 << bits - 1) if bits else F.lit(0)
    rows = words.select(shard.cast("int").alias("shard"), "key", "count").repartition(1 << bits, "shard").sortWithinPartitions("shard", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def end() -> pa.RecordBatch:
            keys, counts = (np.concatenate(c) for c in zip(*held))
            save(folder, "word", now, {"key": keys, "count": small(counts)})
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([len(keys)], pa.int64())], names=["shard", "n"])

        for batch in batches:
            s, keys, counts = (c.to_numpy() for c in batch.columns)
            cuts = [0, *(np.flatnonzero(np.diff(s)) + 1).tolist(), len(s)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and int(s[a]) != now:
                    yield end()
                now = int(s[a])
                held.append((keys[a:b].copy(), counts[a:b].copy()))
        if held:
            yield end()

    sizes = {r["shard"]: r["n"] for r in materialised(arrow_map(rows, run, "shard int, n long"), "word-shards").collect()}
    return np.cumsum([0, *(sizes.get(i, 0) for i in range(1 << bits))])[:-1].tolist()


def _counted(source: DataFrame, model: Model) -> DataFrame:
    """Blocks of the longest n-grams, ids and counts."""
    order, bits = model.order, model.gram_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, held, n = model.vocabulary(), [], 0

        def out() -> Iterator[pa.RecordBatch]:
            ids = [np.concatenate(c) for c in zip(*held)]
            held.clear()
            h, ids, counts = summed(mixed(*ids), ids, [np.ones(len(ids[0]), dtype=np.int64)])
            yield from _blocks("gram", bits, h, [*ids, *counts])

        for batch in batches:
            for words, counts, _ in runs([t.as_py() for t in batch.column(1)], order):
                held.append([c.astype(np.uint32) for c in windows(vocabulary.encode(words)[0], counts, order)])
                n += len(held[-1][0])
                if n >= CHUNK:
                    yield from out()
                    n = 0
        if held:
            yield from out()

    return arrow_map(source, run, BLOCK)


def _level(blocks: DataFrame, model: Model, length: int) -> DataFrame:
    """Writes the arrays of the n-grams of a length; blocks of their contexts, of shorter n-grams, and their numbers."""
    folder, bits = model.folder, model.gram_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, columns in _gathered(batches):
            ids, h = columns[:-1], mixed(*columns[:-1])
            h, ids, (count,) = summed(h, ids, [columns[-1].astype(np.int64)])
            save(folder, f"gram{length}", shard, {"key": h, "count": small(count)})
            have = [(count == i).sum() for i in (1, 2, 3, 4)]
            yield from _blocks("sizes", 0, np.zeros(1, dtype=np.int64), [np.array([x], dtype=np.int64) for x in (count.sum(), (count > 2).sum(), *have)])
            if length > 1:
                one = [count, *((count == i).astype(np.int64) for i in (1, 2)), (count > 2).astype(np.int64)]
                key, _, sums = summed(mixed(*ids[:-1]), [], one)
                yield from _blocks("context", bits, key, [key, *sums])
                begins = ids[1] == BEGIN_ID
                key, shorter, sums = summed(mixed(*ids[1:]), ids[1:], [np.where(begins, count, 1)])
                yield from _blocks("gram", bits, key, [*shorter, *sums])

    return materialised(arrow_map(_by_shard(blocks, bits), run, BLOCK), f"grams-{length}", ["kind"])


def _contexts(blocks: DataFrame, model: Model, length: int) -> None:
    folder = model.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (h, *values) in _gathered(batches):
            h, _, sums = summed(h, [], [v.astype(np.int64) for v in values])
            save(folder, f"context{length}", shard, {"key": h} | {n: small(s) for n, s in zip(("total", "one", "two", "more"), sums)})
            yield pa.RecordBatch.from_arrays([pa.array([len(h)], pa.int64())], names=["n"])

    arrow_map(_by_shard(blocks, model.gram_bits), run, "n long").agg(F.sum("n")).collect()


def discounts(have: list[int]) -> tuple[float, float, float]:
    """Of counts 1, 2 and 3 or more, from how many n-grams count 1 to 4; fixed ones where these don't tell."""
    if min(have) > 0:
        y = have[0] / (have[0] + 2 * have[1])
        d = tuple(i - (i + 1) * y * have[i] / have[i - 1] for i in (1, 2, 3))
        if all(0 <= x <= i for i, x in enumerate(d, 1)):
            return d
    return 0.5, 1.0, 1.5


def fit(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", order: int = ORDER, folder: str | None = None) -> Model:
    """The model of the documents outside the held-out fifth; its files go with the application unless folder says where."""
    spark = documents.sparkSession
    folder = local_path(folder or new_folder(spark, "kneser-ney"))
    source = _source(documents, id_column, text_column).filter(~F.col("held")).select("id", "t")
    words = materialised(_word_counts(source), "word-counts")
    size = words.agg(F.count(F.lit(1)).alias("words"), F.coalesce(F.sum("count"), F.lit(0)).alias("tokens")).first()
    bits = bits_for(size["words"])
    offsets = _save_words(words, folder, bits)
    discard(words)
    model = Model(order, folder, bits, offsets, size["tokens"], size["words"], bits_for(size["tokens"]))
    blocks, before = _counted(source, model), None
    for length in range(order, 0, -1):
        made = _level(blocks, model, length)
        if before:
            discard(before)
        numbers = np.zeros(6, dtype=np.int64)
        for r in made.filter("kind = 'sizes'").select("data").toLocalIterator():  # six numbers a shard
            numbers += np.concatenate(unpack(r["data"]))
        model.discounts.insert(0, discounts(numbers[2:].tolist()))
        if length > 1:
            _contexts(made.filter("kind = 'context'").select("kind", "shard", "data"), model, length)
            blocks, before = made.filter("kind = 'gram'").select("kind", "shard", "data"), made
        else:
            model.singles = (int(numbers[0]), int(numbers[2]), int(numbers[3]), int(numbers[1]))
            discard(made)
    return model


def _source(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    need(documents, id_column, text_column)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary")
    return documents.select(F.col(id_column).alias("id"), text.alias("t"), held_out(id_column).alias("held"))


def scored(documents: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probability) of each document."""
    source = _source(documents, id_column, text_column)
    names = [id_column, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = model.vocabulary()
        floor = model.tokens + 0.5 * (model.words + 1)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                n = batch.num_rows
                tokens, known, base, score = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n)
                for words, counts, owner in runs([t.as_py() for t in batch.column(1)], model.order):
                    ids, seen = vocabulary.encode(words)
                    owner, seen = owner[counts], seen[counts]
                    p = model.probabilities(windows(ids, counts, model.order))
                    tokens += np.bincount(owner, minlength=n)
                    known += np.bincount(owner[seen > 0], minlength=n)
                    base += np.bincount(owner, np.log10((seen + 0.5) / floor), n)
                    score += np.bincount(owner, np.log10(p), n)
                train = np.full(n, model.tokens, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *map(pa.array, (tokens, known, train, base, score))], names=names)

    schema = f"`{id_column}` {source.dtypes[0][1]}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return arrow_map(source, run, schema)
