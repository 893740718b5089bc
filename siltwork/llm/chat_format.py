r"""Chat formatting that a grammar reads back.

The template, a turn after a turn:

    user       [INST] text [/INST]
    assistant  <s> text </s>
    system     <<SYS>> text <</SYS>>
    other      [ROLE name] text [/ROLE]

Between an opening and its closing mark stands the text with one space on either side. A backslash makes the
next character plain. The parser is deterministic: it reads an opening mark, then takes characters until the
first closing mark of that kind that no backslash precedes. Each turn is rendered plainly first and read
back; if the recovered role and text aren't the source's, the conflicting content is escaped, and the turn
is read again until it is identical. What the parser does at a turn depends on nothing behind it, so turns
that are read back one by one are read back in a row, whatever their number.

The loss mask is the span of each assistant's text, escapes included.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialised, need

# Fixed values of the template
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[ROLE ", "[/ROLE]")
CONTROL = ("</s>", "<s>", "<</SYS>>", "<<SYS>>", "[/INST]", "[INST]", "[/ROLE]", "[ROLE ")

CLOSING = {close: re.compile(r"(?s)((?:\\.|(?! " + re.escape(close) + r")[^\\])*+) " + re.escape(close)) for _, close in (*MARKS.values(), OTHER)}
OTHER_OPEN = re.compile(r"(?s)\[ROLE ((?:\\.|[^\\\]])*+)\] ")
UNESCAPE = re.compile(r"(?s)\\(.)")
#: a backslash, or a place where a control string begins
CONFLICT = re.compile(r"\\|" + "|".join(f"(?={re.escape(c)}).| (?={re.escape(c)})" for c in CONTROL))


class GrammarError(ValueError):
    """The text isn't of the template's language."""


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


def escape(text: str) -> str:
    return CONFLICT.sub(lambda m: "\\" + m[0], text)


def _render(role: str, text: str) -> tuple[str, int, int]:
    """A turn and the span of its text."""
    if role in MARKS:
        opening, close = MARKS[role]
        opening += " "
    else:
        opening, close = f"{OTHER[0]}{re.sub(r'([\\\]])', r'\\\1', role)}] ", OTHER[1]
    return f"{opening}{text} {close}", len(opening), len(opening) + len(text)


def parse_turn(text: str, at: int = 0) -> tuple[str, int, int, int]:
    """The turn that begins at `at`: its role, the span of its escaped text and its end."""
    for role, (opening, close) in MARKS.items():
        if text.startswith(opening + " ", at):
            begin = at + len(opening) + 1
            break
    else:
        found = OTHER_OPEN.match(text, at)
        if not found:
            raise GrammarError(f"no turn begins at {at}")
        role, begin, close = unescape(found[1]), found.end(), OTHER[1]
        if role in MARKS:
            raise GrammarError(f"{role} has marks of its own")
    found = CLOSING[close].match(text, begin)
    if not found:
        raise GrammarError(f"the turn at {at} has no end")
    return role, begin, found.end(1), found.end()


def parse(text: str) -> list[tuple[str, str]]:
    """All turns of a formatted conversation, unescaped."""
    turns, at = [], 0
    while at < len(text):
        role, begin, end, at = parse_turn(text, at)
        turns.append((role, unescape(text[begin:end])))
    return turns


def render_turn(role: str, text: str) -> tuple[str, int, int, int]:
    """The turn as the grammar gives it back identically, its text's span, and how often it was escaped (0 or 1)."""
    for tries, content in enumerate((text, escape(text))):
        turn, begin, end = _render(role, content)
        try:
            found, b, e, after = parse_turn(turn)
        except GrammarError:
            continue
        if after == len(turn) and found == role and unescape(turn[b:e]) == text:
            return turn, begin, end, tries
    raise GrammarError(f"a {role} turn can't be told from its surroundings")


def formatted_turns(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each row of df as its turn of the formatted conversation: conv, turn, segment, loss_begin, loss_end, escapes.

    A conversation's text is its segments in the order of turn (null first), then role and text; equal rows
    are equal segments. Null text and null role are empty. loss_begin and loss_end are null but for the
    assistant's turns. A long conversation stays spread over its rows.
    """
    need(df, conversation, turn, role, text)
    source = df.select(
        F.col(conversation).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*render_turn(r, t), r == "assistant") for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            begin = pa.array([r[1] if r[4] else None for r in rows], pa.int32())
            end = pa.array([r[2] if r[4] else None for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array([r[0] for r in rows], pa.string()), begin, end, pa.array([r[3] for r in rows], pa.int32())],
                names=["conv", "turn", "role", "text", "segment", "loss_begin", "loss_end", "escapes"],
            )

    kinds = dict(source.dtypes)
    schema = f"conv {kinds['conv']}, turn {kinds['turn']}, role string, text string, segment string, loss_begin int, loss_end int, escapes int"
    return arrow_map(source, run, schema)


def conversation_facts(turns: DataFrame) -> DataFrame:
    """turns(conv, turn, order, segment, loss_begin, loss_end) read back, one row for each conversation.

    Segments are read in sorted order and hashed as they come, so a task holds one batch, not one
    conversation. The hash of a conversation is sequential by its definition; the rest isn't.
    """
    kind = dict(turns.dtypes)["conv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None  # conversation, turns, hash of turns, loss characters, hash of loss, characters
        out: list[tuple] = []
        conv_type = None

        def close() -> None:
            out.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def flush() -> pa.RecordBatch:
            types = (conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)
            out.clear()
            return batch

        for batch in batches:
            conv_type = batch.schema.field(0).type
            for conv, segment, begin, end in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if state is None or state[0] != conv:
                    if state is not None:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(segment):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                if begin is not None:
                    learned = unescape(segment[begin:end])
                    state[3] += len(learned)
                    state[4].update(learned.encode())
                state[5] += len(segment)
            if len(out) >= 1000:
                yield flush()
        if state is not None:
            close()
            yield flush()

    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    ordered = turns.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "segment", "loss_begin", "loss_end")
    return arrow_map(ordered, run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def formatted(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conversation_facts of df's formatted turns as read back from the shared folder."""
    turns = materialised(formatted_turns(df, conversation, turn, role, text), "chat-turns")
    return conversation_facts(turns).withColumnRenamed("conv", conversation)
