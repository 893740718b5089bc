"""Conversation structure repair by a lazily determinised weighted automaton.

Role initials of a sound conversation match (s?(ua)+)?, an automaton of four states. Keep, Rerole, Delete and
Insert turn a conversation into one that it accepts, each at a cost. Rows are read from the last to the first:
what matters of those read is, for each state, the least cost of repairing them from there, a vector of four
numbers. Less its least number it is one of a few vectors, the states of the determinised automaton; they and
their transitions are made when first met and kept in a table, so a row costs one look-up. The walk back, from
the first row on, follows tight arcs, those that explain a vector's number, the letter that is least in ASCII
first: it gives the least of the cheapest audits. In an audit the k-th letter that leaves a row says its role.

Defined results: null roles and texts are one blank. Rows of one turn are in the order of role and SHA-256 of the text;
null turns come first; rows without a conversation are one conversation. A role counts by its first character. Rows of
equal conversation, turn, role and text are counted before they are shuffled. A conversation's hash is sequential by
its definition: its texts stream through one task, which holds three bytes for each of its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, need

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs
START, SYSTEM, USER, ASSISTANT = range(4)  # states: what was emitted last
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: the user or assistant state that follows each state, the only one that Rerole and Insert can reach
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 40
OK, CUT, BLANK, COPY = range(4)  # faults; a row's symbol is 4 * fault + the place of its initial in INITIALS
INITIALS = "sua"


class Automaton:
    """The determinised automaton, as far as it has been needed."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.known: dict[tuple[int, ...], int] = {}
        self.after: list[list[int]] = []  # state, symbol: the next state, or -1
        self.weight: list[list[int]] = []
        self.tight: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.end = self._state(self._closed([0, FAR, FAR, 0]))[0]

    @staticmethod
    def _closed(vector: list[int]) -> list[int]:
        """Least costs where rows may be inserted; no state is worth visiting twice."""
        for _ in range(2):
            vector = [min(c, INSERT + vector[NEXT[q]]) for q, c in enumerate(vector)]
        return vector

    def _state(self, vector: list[int]) -> tuple[int, int]:
        least = min(vector)
        normal = tuple(c - least for c in vector)
        if normal not in self.known:
            self.known[normal] = len(self.vectors)
            self.vectors.append(normal)
            self.after.append([-1] * 16)
            self.weight.append([0] * 16)
        return self.known[normal], least

    @staticmethod
    def _arcs(q: int, symbol: int) -> list[tuple[str, int, int]]:
        """Letter, cost and target of what may be done with a row in state q, letters in ASCII order."""
        fault, initial = divmod(symbol, 4)
        arcs = [("D", DELETE, q)]
        if fault < BLANK:
            extra = TRUNCATED * (fault == CUT)
            kept = STEP.get((q, (INITIALS + " ")[initial]))
            if kept is not None:
                arcs.append(("K", KEEP + extra, kept))
            arcs.append(("R", REROLE + extra, NEXT[q]))
        return arcs

    def step(self, state: int, symbol: int) -> None:
        after = self.vectors[state]
        vector = self._closed([min(cost + after[to] for _, cost, to in self._arcs(q, symbol)) for q in range(4)])
        self.after[state][symbol], self.weight[state][symbol] = self._state(vector)

    def scan(self, symbols: bytes) -> tuple[int, bytearray]:
        """The least cost of a conversation, and the states that stand behind each of its rows (the last one first)."""
        state, cost, passed = self.end, 0, bytearray()
        for symbol in reversed(symbols):
            passed.append(state)
            if self.after[state][symbol] < 0:
                self.step(state, symbol)
            cost += self.weight[state][symbol]
            state = self.after[state][symbol]
        return cost + self.vectors[state][START], passed

    def arc(self, q: int, state: int, symbol: int) -> tuple[str, int]:
        """Letters up to and with the row's own, and the state reached: the tight arcs from q, least letter first."""
        found = self.tight.get((q, state, symbol))
        if found is None:
            at, after, letters = q, self.vectors[state], ""
            here = [c + self.weight[state][symbol] for c in self.vectors[self.after[state][symbol]]]
            while not letters.strip("I"):
                tight = [(a, to) for a, cost, to in self._arcs(at, symbol) if cost + after[to] == here[at]]
                if INSERT + here[NEXT[at]] == here[at]:
                    tight.append(("I", NEXT[at]))
                letter, at = min(tight)
                letters += letter
            found = self.tight[q, state, symbol] = letters, at
        return found

    def last(self, q: int) -> str:
        """Rows inserted behind the last one."""
        letters, vector = "", self.vectors[self.end]
        while vector[q]:
            letters, q = letters + "I", NEXT[q]
        return letters

    def repair(self, symbols: bytes) -> tuple[int, list[str]]:
        """The least cost, and for each row the letters up to and with its own; then those behind the last row."""
        cost, passed = self.scan(symbols)
        q, found = START, []
        for symbol, state in zip(symbols, reversed(passed)):
            letters, q = self.arc(q, state, symbol)
            found.append(letters)
        return cost, [*found, self.last(q)]


def _last_character(text: Column) -> Column:
    """The last character that isn't white space; empty where there is none."""
    return F.substring(F.rtrim(text, F.lit(" \t\n\x0b\f\r")), -1, 1)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text, copies: the rows after damage; copies is 0 for one that it drops and 2 for one that it repeats."""
    need(conversations, "conv_id", "turn", "role", "text")
    blank = F.lit(" ")
    text = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    rows = conversations.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"),
        (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).alias("x"),
    )
    x = F.col("x")
    return rows.select(
        "conv", "turn", F.when(x == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(x == 1, "").when(x == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(x == 0, 0).when(x == 3, 2).otherwise(1).alias("copies"),
    )


def _ordered(rows: DataFrame) -> DataFrame:
    """Facts of rows first (flag 0: n equal rows, the first one's symbol, its initial), then the texts (flag 1), by conversation."""
    marked = rows.withColumn("sha", F.unhex(F.sha2("text", 256)))
    last = _last_character(F.col("text"))
    fault = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), OK).otherwise(CUT)
    initial = F.when(F.substring("role", 1, 1) == "s", 0).when(F.substring("role", 1, 1) == "u", 1).when(F.substring("role", 1, 1) == "a", 2).otherwise(3)
    facts = marked.withColumn("fault", fault).groupBy("conv", "turn", "role", "sha", "fault").agg(F.sum("copies").alias("n"))
    first = facts.filter(f"n > 0 and fault <> {BLANK}").groupBy(F.col("conv").alias("f_conv"), F.col("role").alias("f_role"), F.col("sha").alias("f_sha"))
    first = first.agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"))
    same = F.col("conv").eqNullSafe(F.col("f_conv")) & (F.col("role") == F.col("f_role")) & (F.col("sha") == F.col("f_sha"))
    facts = facts.join(first, same, "left")
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn")) & (F.col("fault") != BLANK)
    symbol = 4 * F.when(later, COPY).otherwise(F.col("fault")) + initial
    none = F.lit(None).cast("string")
    facts = facts.select("conv", F.lit(0).alias("flag"), "turn", "role", "sha", "n", symbol.cast("int").alias("symbol"), none.alias("text"))
    texts = marked.filter("copies > 0").select("conv", F.lit(1).alias("flag"), "turn", "role", "sha", F.col("copies").cast("long").alias("n"), F.lit(0).alias("symbol"), "text")
    return facts.union(texts).repartition("conv").sortWithinPartitions("conv", "flag", "turn", "role", "sha")


class _Conversation:
    """What a task holds of the conversation at hand."""

    def __init__(self, conv, automaton: Automaton):
        self.conv, self.automaton = conv, automaton
        self.symbols, self.turns, self.distinct = bytearray(), None, 0
        self.letters: list[str] | None = None

    def fact(self, turn, n: int, symbol: int) -> None:
        if not n:
            return
        again = symbol if symbol // 4 == BLANK else symbol % 4 + 4 * COPY
        self.symbols += bytes([symbol]) + bytes([again]) * (n - 1)
        if turn is not None:
            if self.turns is None or turn != self.turns[1]:
                self.distinct += 1
            self.turns = (turn if self.turns is None else self.turns[0], turn)

    def known(self) -> None:
        """All facts are in: the repair."""
        self.cost, self.letters = self.automaton.repair(bytes(self.symbols))
        self.hash, self.state, self.at, self.begun = hashlib.sha256(), START, 0, False

    def text(self, role: str, text: str, n: int) -> None:
        if self.letters is None:
            self.known()
        for _ in range(n):
            self._say(self.letters[self.at], role, text)
            self.at += 1

    def _say(self, letters: str, role: str, text: str) -> None:
        for letter in letters:
            if letter == "D":
                continue
            kept = STEP[self.state, role[0]] if letter == "K" else None
            self.state = kept if kept is not None else NEXT[self.state]
            name = role if letter == "K" else NAMES[self.state]
            said = "" if letter == "I" else text
            self.hash.update(f"{chr(10) * self.begun}{name}:{said}".encode())
            self.begun = True

    def row(self) -> tuple:
        if self.letters is None:
            self.known()
        self._say(self.letters[-1], "", "")
        s = bytes(self.symbols)
        faults = [sum(s.count(4 * f + i) for i in range(4)) for f in range(4)]
        initials = s.translate(bytes(i % 4 for i in range(256)))
        sound = sum(initials[1:][k] == b and initials[k] == a for k in range(len(s) - 1) for a, b in ((0, 1), (1, 2), (2, 1)))
        gaps = self.turns[1] - self.turns[0] + 1 - self.distinct if self.turns else 0
        return (self.conv, gaps, faults[BLANK], faults[COPY], faults[CUT], max(0, len(s) - 1) - sound, self.cost, "".join(self.letters), self.hash.hexdigest())


def repaired(conversations: DataFrame) -> DataFrame:
    """One row for each conversation: its gaps and faults after damage, the repair's cost and audit, and the hash of what it gives.

    A conversation that the damage leaves without rows has zeros, an empty audit and the hash of the empty text.
    """
    ordered = _ordered(damaged(conversations))
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = f"conv_id {ordered.dtypes[0][1]}, " + ", ".join(f"{n} long" for n in names) + ", audit string, repaired_sha256 string"
    kind = [ordered.schema["conv"].dataType]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        automaton, now, done = Automaton(), None, []
        types = [to_arrow_type(kind[0]), *[pa.int64()] * 6, pa.string(), pa.string()]

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=["conv_id", *names, "audit", "repaired_sha256"])
            done.clear()
            return batch

        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                for conv, flag, turn, role, _, n, symbol, text in zip(*(c.to_pylist() for c in part.columns)):
                    if now is None or now.conv != conv:
                        if now is not None:
                            done.append(now.row())
                        now = _Conversation(conv, automaton)
                    if flag:
                        now.text(role, text, n)
                    else:
                        now.fact(turn, n, symbol)
                if done:
                    yield out()
        if now is not None:
            done.append(now.row())
            yield out()

    return arrow_map(ordered, run, schema)
