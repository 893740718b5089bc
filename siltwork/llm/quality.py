"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. The encoder turns each passage into the frequencies of
pairs of neighbouring characters' classes and a few rates, and a learned layer into a vector h. Gated
attention, a = softmax(w . (tanh(V h) * sigmoid(U h))), weighs the passages of a document, and the weighted
vector is scored. All weights are learned from document labels alone, on at most `most_labels` labelled rows,
which are drawn by a hash of the id; every document is scored, from its whole text.

The text is the only input of a score. Empty texts have one passage without characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import arrow_map, discard, materialised, need

PASSAGE = 64  # words
HELD_OUT = 2  # remainder of the id's CRC-32 by 4 that is never learned from
THRESHOLD = 0.7

#: Class of each byte: 0 other ASCII marks, 1 blank, 2 line end, 3 a-z, 4 A-Z, 5 digit, 6 . and , 7 ! and ?
#: 8 * 9 # 10 $ 11 % 12 & 13 | 14 quotes, 15 bytes of other scripts
CLASSES = np.zeros(256, dtype=np.uint8)
for _members, _class in (
    (b" ", 1), (b"\t\n\x0b\x0c\r", 2), (bytes(range(97, 123)), 3), (bytes(range(65, 91)), 4), (b"0123456789", 5), (b".,", 6), (b"!?", 7), (b"*", 8),
    (b"#", 9), (b"$", 10), (b"%", 11), (b"&", 12), (b"|", 13), (b"'\"", 14), (bytes(range(128, 256)), 15),
):
    CLASSES[list(_members)] = _class
PAIRS = 256
FEATURES = PAIRS + 4  # and rates: words a line, distinct words, repeated neighbours, length of words


def held_out(id_column: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages and, for each passage, the number of its text. Each text has at least one."""
    rows, owner = [], []
    for i, text in enumerate(texts):
        words = text.split()
        count = max(1, -(-len(words) // PASSAGE))
        data = CLASSES[np.frombuffer(text, dtype=np.uint8)].astype(np.int64)
        blank = (data == 1) | (data == 2)
        begins = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])) if len(data) else np.zeros(0, dtype=np.int64)
        passage = np.zeros(len(data), dtype=np.int64)
        if count > 1:
            passage[begins[PASSAGE::PASSAGE]] = 1
            passage = np.cumsum(passage)
        pairs = passage[1:] * PAIRS + data[:-1] * 16 + data[1:]
        table = np.bincount(pairs, minlength=count * PAIRS)[: count * PAIRS].reshape(count, PAIRS).astype(np.float32)
        lines = np.bincount(passage[data == 2], minlength=count)[:count] if len(data) else np.zeros(count)
        rates = np.zeros((count, 4), dtype=np.float32)
        for k in range(count):
            part = words[k * PASSAGE : (k + 1) * PASSAGE]
            n = max(1, len(part))
            rates[k] = lines[k] / n, len(set(part)) / n, sum(a == b for a, b in zip(part, part[1:])) / n, min(sum(map(len, part)) / n, 40) / 20
        rows.append(np.concatenate([np.sqrt(table / np.maximum(table.sum(axis=1, keepdims=True), 1)), rates], axis=1))
        owner.append(np.full(count, i))
    return np.concatenate(rows), np.concatenate(owner)


def _softmax_by(owner: np.ndarray, scores: np.ndarray, bags: int) -> np.ndarray:
    top = np.full(bags, -np.inf)
    np.maximum.at(top, owner, scores)
    e = np.exp(scores - top[owner])
    return e / np.bincount(owner, e, bags)[owner]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _sums(owner: np.ndarray, values: np.ndarray, bags: int) -> np.ndarray:
    """Sums of the rows of each bag; owner is sorted and every bag has a row."""
    return np.add.reduceat(values, np.searchsorted(owner, np.arange(bags)), axis=0)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, owner: np.ndarray, bags: int) -> dict[str, np.ndarray]:
        w = self.weights
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ w["E"] + w["e"])
        t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        a = _softmax_by(owner, (t * g) @ w["w"], bags)
        z = _sums(owner, h * a[:, None], bags)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["b"])}

    def score(self, texts: list[bytes]) -> np.ndarray:
        x, owner = encode(texts)
        return self.forward(x, owner, len(texts))["p"]

    def attention(self, text: bytes) -> np.ndarray:
        """The weight of each passage of a text."""
        x, owner = encode([text])
        return self.forward(x, owner, 1)["a"]


def _gradients(model: Model, f: dict, owner: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    w = model.weights
    dp = (f["p"] - y) * weight / weight.sum()
    dz = dp[:, None] * w["c"]
    dh = f["a"][:, None] * dz[owner]
    da = (f["h"] * dz[owner]).sum(axis=1)
    ds = f["a"] * (da - np.bincount(owner, f["a"] * da, len(y))[owner])
    dt, dg = ds[:, None] * w["w"] * f["g"], ds[:, None] * w["w"] * f["t"]
    pt, pg = dt * (1 - f["t"] ** 2), dg * f["g"] * (1 - f["g"])
    dh += pt @ w["V"].T + pg @ w["U"].T
    ph = dh * (1 - f["h"] ** 2)
    return {"E": f["x"].T @ ph, "e": ph.sum(0), "V": f["h"].T @ pt, "U": f["h"].T @ pg, "w": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ dp, "b": np.array([dp.sum()])}


def train(texts: list[bytes], labels: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 30, batch: int = 64, rate: float = 0.01, seed: int = 11) -> Model:
    """Adam on the log loss, both labels with equal total weight. Without both labels the score is their mean."""
    rng = np.random.default_rng(seed)
    shapes = {"E": (FEATURES, hidden), "e": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,), "c": (hidden,), "b": (1,)}
    weights = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or k in "wc" else np.zeros(s) for k, s in shapes.items()}
    labels = labels.astype(float)
    if len(set(labels.tolist())) < 2:
        weights = {k: np.zeros(s) for k, s in shapes.items()}
        weights["b"][:] = 0.0 if not len(labels) else 20.0 if labels[0] else -20.0
        return Model(np.zeros(FEATURES), np.ones(FEATURES), weights)
    x, owner = encode(texts)
    model = Model(x.mean(0), x.std(0) + 0.02, weights)
    starts = np.searchsorted(owner, np.arange(len(texts) + 1))
    balance = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    m, v, step = {k: 0.0 for k in weights}, {k: 0.0 for k in weights}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for s in range(0, len(order), batch):
            chosen = order[s : s + batch]
            rows = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in chosen])
            mine = np.repeat(np.arange(len(chosen)), starts[chosen + 1] - starts[chosen])
            f = model.forward(x[rows], mine, len(chosen))
            step += 1
            now = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for k, d in _gradients(model, f, mine, labels[chosen], balance[chosen]).items():
                d = d + 1e-4 * weights[k]
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                weights[k] -= now * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def fit(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", most_labels: int = 6000, most_bytes: int = 1 << 28) -> Model:
    """Learns from at most most_labels labelled rows of most_bytes bytes of text outside the held-out quarter.

    Rows with a null label or id don't teach. They are drawn by a hash of the id until there are about
    enough, and then cut by that hash, so the draw is the same in every run. Of these, rows teach in that order as long as
    their texts together stay within most_bytes.
    """
    need(documents, id_column, text_column)
    need(labels, id_column, label_column)
    known = labels.select(F.col(id_column).alias("l_id"), F.col(label_column).cast("int").alias("y")).filter("l_id is not null and y in (0, 1)")
    known = known.groupBy("l_id").agg(F.max("y").alias("y"))
    usable = known.filter(~held_out("l_id")).withColumn("draw", F.pmod(F.xxhash64("l_id", F.lit(3)), F.lit(1_000_000)))
    total = usable.count()
    drawn = usable.filter(F.col("draw") < min(1_000_000, 1_000_000 * (most_labels + 500) // max(1, total)))
    drawn = drawn.orderBy("draw", "l_id").limit(most_labels)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary")
    texts = documents.select(F.col(id_column).alias("d_id"), text.alias("t"))
    # drawn has at most most_labels rows of three numbers
    taught = materialised(texts.join(F.broadcast(drawn), F.col("d_id") == F.col("l_id")).select("draw", "l_id", "t", "y", F.xxhash64("t").alias("h")), "taught")
    order = ["draw", "l_id", "h"]
    sizes = taught.select(*order, F.octet_length("t").alias("n")).orderBy(*order).limit(most_labels).collect()
    fit_in = int(np.searchsorted(np.cumsum([r["n"] for r in sizes]), most_bytes, side="right"))
    rows = taught.select(*order, "t", "y").orderBy(*order).limit(fit_in).collect() if fit_in else []
    discard(taught)
    return train([bytes(r["t"]) for r in rows], np.array([r["y"] for r in rows]))


def scored(documents: DataFrame, model: Model, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """documents with the score of each whole text; a null text counts as empty. A column of that name is replaced."""
    need(documents, text_column)
    documents = documents.drop(score_column)
    names, at = documents.columns, documents.columns.index(text_column)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # some 60 kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                batch = whole.slice(start, 200)
                texts = [(t or "").encode() for t in batch.column(at).to_pylist()]
                p = shared.value.score(texts)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*names, score_column])

    return arrow_map(documents, run, StructType([*documents.schema.fields, StructField(score_column, DoubleType())]))
