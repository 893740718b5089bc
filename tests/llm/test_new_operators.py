"""Language model, conversation repair and vector codes: brute force, odd inputs and planted cases."""

import hashlib
import math
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from siltwork.llm import conversation_repair as cr  # noqa: E402
from siltwork.llm import kneser_ney as kn  # noqa: E402
from siltwork.llm import vector_codes as vc  # noqa: E402
from siltwork.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402
from tools.compare import duck, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
WS = "\x20\x09-\x0d"


@pytest.mark.parametrize("name", ["op11_kneser_ney", "op12_conversation_repair", "op13_vector_codes"])
def test_query_equals_its_sql(spark, name):
    df = QUERIES[name](spark, SF)
    got, names = rows_of(df.columns, df.collect())
    want, wanted = rows_of(*duck(SF, ORACLE_SQL[name]))
    assert names == wanted and got == want


# --- language model ---


def tokens_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(f"[^{WS}]+", low), None]


def brute_model(texts, order):
    """p(window) of the textbook recursion, over dictionaries."""
    grams = [Counter() for _ in range(order + 1)]
    for t in texts:
        w = ["<"] * (order - 1) + tokens_of(t)
        for i in range(order - 1, len(w)):
            grams[order][tuple(w[i - order + 1 : i + 1])] += 1
    vocabulary = {g[-1] for g in grams[order]}
    for n in range(order - 1, 0, -1):
        for g, c in grams[n + 1].items():
            grams[n][g[1:]] += c if n > 0 and g[1] == "<" else 1

    def discount(n):
        have = [sum(c == k for c in grams[n].values()) for k in (1, 2, 3, 4)]
        if min(have) > 0:
            y = have[0] / (have[0] + 2 * have[1])
            d = [k - (k + 1) * y * have[k] / have[k - 1] for k in (1, 2, 3)]
            if all(0 <= x <= k for k, x in enumerate(d, 1)):
                return [0, *d]
        return [0, 0.5, 1.0, 1.5]

    discounts = [None] + [discount(n) for n in range(1, order + 1)]
    after = [defaultdict(list) for _ in range(order + 1)]
    for n in range(1, order + 1):
        for g, c in grams[n].items():
            after[n][g[:-1]].append(c)

    def p(window):
        n = len(window)
        lower = p(window[1:]) if n > 1 else 1 / (len(vocabulary) + 1)
        seen = after[n].get(window[:-1])
        if not seen:
            return lower
        d, c = discounts[n], grams[n].get(window, 0)
        return max(c - d[min(c, 3)], 0) / sum(seen) + sum(d[min(x, 3)] for x in seen) / sum(seen) * lower

    return p, vocabulary


def odd_documents():
    rng = random.Random(4)
    words = ["the", "The", "a", "cat", "dog", "ran", "é", "🙂", "sat", "on", "mat", "</s>", "x" * 300]
    texts = [" ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randrange(0, 40))) for _ in range(60)]
    return [*enumerate(texts), (100, None), (101, ""), (102, "\n \t"), (None, "the cat"), (None, None), (3, "the cat"), (3, "the cat"), (103, "unseen words only here")]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model_equals_brute_force(spark, order, monkeypatch):
    rows = odd_documents()
    df = spark.createDataFrame([(*r, "c", 1.0, "k") for r in rows], "doc_id long, text string, t string, score double, kind string").repartition(3)
    model = kn.fit(df, order=order)
    out = kn.scored(df, model).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    train = [t for i, t in rows if not held(i)]
    p, vocabulary = brute_model(train, order)
    counts = Counter(w for t in train for w in tokens_of(t))
    total = sum(counts.values())
    want = Counter()
    for i, t in rows:
        w = ["<"] * (order - 1) + tokens_of(t)
        score = sum(math.log10(p(tuple(w[k - order + 1 : k + 1]))) for k in range(order - 1, len(w)))
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (len(vocabulary) + 1))) for x in tokens_of(t))
        want[str(i), held(i), len(tokens_of(t)), sum(counts[x] > 0 for x in tokens_of(t)), total, f"{base:.8f}", f"{score:.8f}"] += 1
    got = Counter((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.8f}", f"{r.score:.8f}") for r in out)
    assert got == want
    for context in [("the",), ("<",), ("never",)]:  # all words and the unknown one have probability 1 together
        window = lambda w: (*(["<"] * order), *context, w)[-order:]
        assert sum(p(window(w)) for w in [*vocabulary, "never seen"]) == pytest.approx(1)


def test_language_model_of_many_shards_and_slices(spark, monkeypatch):
    """Small shards, chunks and slices give what large ones give, on texts that are longer than a slice."""
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(600)))) for i in range(40)]
    rows += [(90, "hot pair " * 3000), (91, "y" * 9000 + " tail " + "z" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted(map(tuple, kn.scored(df, kn.fit(df)).collect()))
    for text in (rows[3][1], rows[40][1], rows[41][1], ""):
        monkeypatch.setattr(kn, "SLICE", 700)
        assert [w for some, _ in kn.slices(text.encode()) for w in some] == text.encode().split()
        monkeypatch.undo()
    monkeypatch.setattr(kn, "bits_for", lambda entries: 5)
    got = sorted(map(tuple, kn.scored(df, kn.fit(df)).collect()))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want])


def test_language_model_without_training_rows_or_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    df = spark.createDataFrame([(held, "a b")], "doc_id long, text string")
    out = kn.scored(df, kn.fit(df)).collect()
    assert [tuple(r) for r in out] == [(held, True, 3, 0, 0, 0.0, 0.0)]
    none = df.filter("doc_id < 0")
    assert kn.scored(none, kn.fit(none)).collect() == []


def test_language_model_prefers_what_it_has_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    out = kn.scored(docs, kn.fit(docs)).groupBy("held_out").agg((F.sum("base_score") / F.sum("n_tokens")).alias("base"), (F.sum("score") / F.sum("n_tokens")).alias("score")).collect()
    assert all(r.score > r.base for r in out) and len(out) == 2


def test_a_model_needs_a_mounted_folder():
    assert kn.local_path("file:///a/b") == "/a/b"
    with pytest.raises(RuntimeError):
        kn.local_path("hdfs://host/a")


def test_packed_columns():
    columns = [np.array([-5, 7], dtype=np.int64), np.array([1, 2], dtype=np.uint32), np.array([1, 1 << 40], dtype=np.uint64)]
    assert [c.tolist() for c in kn.unpack(kn.pack(columns))] == [c.tolist() for c in columns]


# --- conversation repair ---


def brute_repair(rows):
    """rows (fault, role, text): least cost, then least audit, over all edit scripts by states, and what it gives."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {(0, ""): (0, "", ())}
    todo = [(0, "")]
    # scripts by length of audit: relax until nothing improves; audits are compared as whole strings
    while todo:
        i, q = todo.pop(0)
        cost, audit, said = best[i, q]
        ways = []
        if i < len(rows):
            fault, role, text = rows[i]
            ways.append((i + 1, q, 4, "D", None))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                if (q, role[:1]) in step:
                    ways.append((i + 1, step[q, role[:1]], extra, "K", (role, text)))
                for r in ("user", "assistant"):
                    if (q, r[0]) in step:
                        ways.append((i + 1, step[q, r[0]], 3 + extra, "R", (r, text)))
        for r in ("user", "assistant"):
            if (q, r[0]) in step:
                ways.append((i, step[q, r[0]], 3, "I", (r, "")))
        for j, to, more, letter, line in ways:
            new = (cost + more, audit + letter, said + ((line,) if line else ()))
            if (j, to) not in best or new[:2] < best[j, to][:2]:
                best[j, to] = new
                todo.append((j, to))
    ends = [best[len(rows), q] for q in ("", "a") if (len(rows), q) in best]
    return min(ends, key=lambda e: e[:2])


def brute_conversation(rows):
    """(turn, role, text) of one conversation, damaged by its id: the query's row."""

    def crc(conv, turn):
        return zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20

    after = []
    for conv, turn, role, text in rows:
        role, text, x = " " if role is None else role, " " if text is None else text, crc(conv, turn)
        if x == 0:
            continue
        text = "" if x == 1 else re.sub("[.!?]", "", text) if x == 2 else text
        role = "user" if x == 4 else role
        after += [(turn, role, text)] * (2 if x == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, judged = set(), []
    for turn, role, text in after:
        bare = re.sub(f"[{WS}]+\\Z", "", text)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "ok"
        seen.add((role, text))
        judged.append((fault, role, text))
    turns = [t for t, _, _ in after if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    count = Counter(f for f, _, _ in judged)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
    cost, audit, said = brute_repair(judged)
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()


def test_repair_equals_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for conv in [*range(250), None]:
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Assistant"])
            text = rng.choice(["Yes.", "No!", "cut of", "", None, " \n", "Yes.", "x. ", "é 🙂?", "a.b", "tail. \t\n"])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 5, 0]), role, text))
    rows += [(900, 1, "user", "hi.")] * 40 + [(901, t, "user", f"same {t % 2}.") for t in range(50)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, sha string, n int").repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in cr.repaired(df).collect()}
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    assert got.keys() == by.keys()
    for conv, own in by.items():
        assert got[conv] == brute_conversation(own), conv


def test_repair_of_dropped_and_empty_conversations(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(dropped, 0, "user", "hi.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in cr.repaired(df).collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert cr.repaired(df.filter("turn > 5")).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["ok", "truncated", "blank", "duplicate"]), st.sampled_from(["s", "u", "a", "o"])), max_size=9))
def test_automaton_equals_all_scripts(rows):
    faults = {"ok": 0, "truncated": 1, "blank": 2, "duplicate": 3}
    symbols = bytes(4 * faults[f] + "suao".index(r) for f, r in rows)
    cost, letters = cr.Automaton().repair(symbols)
    assert (cost, "".join(letters)) == brute_repair([(f, r, "") for f, r in rows])[:2]


def test_automaton_has_few_states():
    automaton = cr.Automaton()
    rng = random.Random(0)
    for _ in range(3000):
        automaton.repair(bytes(rng.randrange(16) for _ in range(rng.randrange(30))))
    before = len(automaton.vectors)
    automaton.repair(bytes(rng.randrange(16) for _ in range(100_000)))
    assert len(automaton.vectors) == before < 50


# --- vector codes ---


def brute_codes(rows, rounds=6):
    """rows (id, whole numbers, label), in order: codes, errors and the codebooks of Lloyd's algorithm, all distances."""
    x = np.array([v for _, v, _ in rows], dtype=object).reshape(len(rows), vc.PARTS, -1)
    books = [[list(x[i, p]) for i in range(min(16, len(rows)))] for p in range(vc.PARTS)]

    def nearest(p, v):
        return min((sum(int(a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(vc.PARTS):
            of = defaultdict(list)
            for v in x[:, p]:
                of[nearest(p, v)[1]].append(v)
            for k, members in of.items():
                books[p][k] = [sum(int(m[d]) for m in members) // len(members) for d in range(len(members[0]))]
    out = []
    for i in range(len(rows)):
        found = [nearest(p, x[i, p]) for p in range(vc.PARTS)]
        out.append(("".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, hashlib.sha256(",".join(str(int(n)) for b in books for e in b for n in e).encode()).hexdigest()


@pytest.mark.parametrize("scale", [0.0005, 0.3, 5000.0])
def test_vector_codes_equal_brute_force(spark, scale):
    """Few distinct values, so that ties abound; tiny, usual and large components."""
    rng = random.Random(7)
    rows = [(i, [round(rng.gauss(0, 1) * 2) / 2 * scale for _ in range(16)], rng.choice([None, 1, 2])) for i in range(400)]
    rows += [(None, rows[5][1], 1), (7, rows[9][1], 2), (7, rows[9][1], None)]
    bad = [(500, None, 1), (501, [None] * 16, 1), (502, [float("nan")] * 16, 1), (503, [float("inf")] * 16, 2), (504, [1.0] * 8, 1), (505, [], 1), (506, [1.0] * 15, 2)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows + bad], "vec_id long, embedding array<float>, label int, code string, kind int").repartition(3)
    whole = [(i, [math.floor(4096 * float(np.float32(c))) for c in v], lab) for i, v, lab in rows]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    codes, digest = brute_codes(whole)
    by = Counter()
    for (_, _, lab), (_, e) in zip(whole, codes):
        by[lab] += e
    want = Counter((i, c, e, by[lab], digest) for (i, _, lab), (c, e) in zip(whole, codes))
    assert Counter(map(tuple, vc.compressed(df).collect())) == want


def test_vector_codes_of_no_and_few_rows(spark):
    df = spark.createDataFrame([(1, [float("nan")] * 8, 1)], "vec_id long, embedding array<float>, label int")
    assert vc.compressed(df).collect() == []
    few = spark.createDataFrame([(2, [1.0] * 8, None), (1, [2.0] * 8, 3), (3, [1e30] * 8, 3)], "vec_id long, embedding array<float>, label int")
    out = {r.vec_id: r for r in vc.compressed(few).collect()}
    assert [out[i].code for i in (1, 2, 3)] == ["00" * 8, "01" * 8, "02" * 8] and all(r.error == 0 for r in out.values())


def test_bounds_prune_and_hold():
    """After a round few entries are looked at, every bound holds, and codes are those of all distances."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-3000, 3000, (16, 8, 4))
    x = centres[rng.integers(0, 16, 3000)] + rng.integers(-60, 60, (3000, 8, 4))
    books = vc.Codebooks(np.ascontiguousarray(x[:16].transpose(1, 0, 2)))
    code, bounds, _, looked = vc.assign(x, books, None, None)
    first = looked
    for _ in range(4):
        sums, counts = np.zeros((8, 16, 4), dtype=np.int64), np.zeros((8, 16), dtype=np.int64)
        for p in range(8):
            np.add.at(sums[p], code[:, p], x[:, p])
            counts[p] = np.bincount(code[:, p], minlength=16)
        books = books.updated(sums, counts)
        code, bounds, _, looked = vc.assign(x, books, code, bounds)
        squares = ((x[:, :, None, :] - books.entries[None]) ** 2).sum(3)
        assert (squares.argmin(2) == code).all()
        root = np.sqrt(squares)
        own = np.take_along_axis(root, code[:, :, None].astype(np.int64), 2)[:, :, 0]
        assert (bounds[:, :, 0].astype(float) >= own * (1 - 1e-12)).all() and (bounds[:, :, 1:].astype(float) <= root * (1 + 1e-12)).all()
    assert looked < first / 4


def test_half_precision_rounds_outwards():
    x = np.concatenate([np.random.default_rng(1).random(10_000) * 10.0 ** np.arange(-3, 7).repeat(1000), [0, 65504, 65505, 1e9]])
    assert (vc.down(x).astype(float) <= x).all() and (vc.up(x).astype(float) >= x).all()
