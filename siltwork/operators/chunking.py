"""Chunking documents into sections, parents and children.

Greedy packing is sequential inside one document and independent between documents, so it runs as a map
over Arrow batches without a shuffle. A token is a word unless a counter is given.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Counter = Callable[[str], int]

SPACE = " \t\n\x0b\f\r"  # what parts words, here as in the SQL functions; other white space of Unicode is part of a word
WORD = re.compile(f"[^{SPACE}]+")
DIGITS = "0123456789"
NUMBERED = re.compile(f"[0-9]+(?:\\.[0-9]+)*[{SPACE}]+[^{SPACE}]")  # how a numbered line of a table of contents begins
FLUSH = 1 << 22  # characters of parents and children that a task holds at once, a document's own aside


def count_words(text: str) -> int:
    return sum(1 for _ in WORD.finditer(text))


def chunk_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), 1, 16)


def word_windows(df: DataFrame, key: str, text: str, size: int, stride: int) -> DataFrame:
    """Windows of `size` words every `stride`: key, idx, text, n_words. The last window ends with the text; a text without words has none."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = df.select(key, words.alias("_w"))
    n = F.size("_w")
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / stride).cast("int") + 1)
    starts = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * stride)).otherwise(F.array().cast("array<int>"))
    rows = rows.select(key, "_w", F.posexplode(starts).alias("idx", "_s"))
    part = F.slice("_w", F.col("_s") + 1, size)
    return rows.select(key, "idx", F.array_join(part, " ").alias("text"), F.size(part).alias("n_words"))


def sections(elements: DataFrame, key: str = "doc", order: str = "pos") -> DataFrame:
    """elements(doc, pos, text, text_level, type) with section number, breadcrumb and title.

    The first level-1 heading is the title; level 2 opens a section; level 3 changes the breadcrumb inside
    one; noise types go. One window a document, no driver loop.
    """
    e = elements.filter(~F.col("type").isin("header", "footer", "page_number"))
    w = Window.partitionBy(key).orderBy(order)
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    level = F.col("text_level")
    e = e.withColumn("section", F.sum((level == 2).cast("int")).over(up))
    inside = Window.partitionBy(key, "section").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumns({
        "title": F.first(F.when(level == 1, F.col("text")), ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "l2": F.last(F.when(level == 2, F.col("text")), ignorenulls=True).over(inside), "l3": F.last(F.when(level == 3, F.col("text")), ignorenulls=True).over(inside),
    })
    return e.withColumn("breadcrumb", F.concat_ws(" > ", "l2", "l3")).drop("l2", "l3")


def split_words(text: str, budget: int, overlap: int, counter: Counter = count_words) -> Iterator[str]:
    """Runs of words of at most `budget` tokens; the next begins with as many of the last words as fit in `overlap`."""
    words = WORD.findall(text)
    if counter is count_words:  # each word is a token, so the runs have fixed strides
        size = max(1, budget)
        stride = size - max(0, min(overlap, size - 1))
        for i in range(0, max(1, len(words) - size + stride) if words else 0, stride):
            yield " ".join(words[i : i + size])
        return
    held: list[str] = []
    used, fresh = 0, False
    for word in words:
        n = counter(word)
        if held and used + n > budget:
            yield " ".join(held)
            tail, kept = [], 0
            for w in reversed(held):
                if kept + counter(w) > overlap or kept + counter(w) + n > budget:
                    break
                tail.insert(0, w)
                kept += counter(w)
            held, used = tail, kept
        held.append(word)
        used, fresh = used + n, True
    if held and fresh:
        yield " ".join(held)


def parents(text: str, budget: int, counter: Counter = count_words) -> Iterator[str]:
    """Paragraphs packed up to the budget; a longer paragraph is cut at sentences, a longer sentence at words."""
    held: list[str] = []
    used = 0
    for paragraph in filter(None, (p.strip(SPACE) for p in (text or "").split("\n"))):
        units = [paragraph]
        if counter(paragraph) > budget:
            units = [s for part in paragraph.replace(". ", ".\0").split("\0") for s in (split_words(part, budget, 0, counter) if counter(part) > budget else [part])]
        for u in units:
            n = counter(u)
            if held and used + n > budget:
                yield "\n".join(held)
                held, used = [], 0
            held.append(u)
            used += n
    if held:
        yield "\n".join(held)


def without_contents(text: str) -> str:
    """The text's lines without its tables of contents.

    A line of contents ends in dots and a page, or begins with a number and ends with a page. Those at most one other line apart are a section, which goes if
    functions.text.looks_like_toc holds for it: five lines, 40 % of them with dots or 60 % with numbers. Its patterns take the square of a run of dots or
    blanks, this a linear time.
    """
    lines = [x for x in (line.strip(SPACE) for line in text.split("\n")) if x]
    found: list[list[int]] = []  # first and last line, dotted and numbered ones of each section
    for i, line in enumerate(lines):
        head = line.rstrip(DIGITS)
        title = head.rstrip(SPACE)
        dotted = head != line and title.endswith("...")
        numbered = head != line and title != head and NUMBERED.match(title) is not None
        if dotted or numbered:
            if not found or i - found[-1][1] > 2:
                found.append([i, i, 0, 0])
            found[-1][1:] = i, found[-1][2] + dotted, found[-1][3] + numbered
    for first, last, dotted, numbered in found:
        n = last - first + 1
        if n >= 5 and (5 * dotted >= 2 * n or 5 * numbered >= 3 * n):
            lines[first : last + 1] = [""] * n
    return "\n".join(filter(None, lines))


def merge_short(chunks: list[str], least: int, counter: Counter = count_words) -> list[str]:
    """Chunks below `least` tokens join the one before them, a first one the next."""
    out: list[str] = []
    for c in chunks:
        if out and (counter(c) < least or counter(out[-1]) < least):
            out[-1] += "\n" + c
        else:
            out.append(c)
    return out


def hierarchical(df: DataFrame, key: str, text: str, parent_tokens: int = 1000, child_tokens: int = 512, overlap: int = 50, least_parent: int = 0, least_child: int = 1, clean: Callable[[str], str] | None = None) -> DataFrame:
    """key, parent_idx, child_idx, parent, text: children of each parent; children below least_child tokens go unless they are all there is.

    `clean` is what is packed of a text; lines are there only before children are cut.
    A task gives a row a parent, with its children as an array, some FLUSH characters at a time; only Spark repeats the parent for each child, and not where nobody reads it.
    """
    kind = dict(df.dtypes)[key]
    names, types = [key, "parent_idx", "parent", "children"], [pa.int32(), pa.string(), pa.list_(pa.string())]

    def made(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        at, *columns = zip(*rows)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, used = [], 0
            for at in range(batch.num_rows):
                whole = batch.column(1)[at].as_py() or ""
                for i, p in enumerate(merge_short(list(parents(clean(whole) if clean else whole, parent_tokens)), least_parent)):
                    parts = list(split_words(p, child_tokens, overlap))
                    rows.append((at, i, p, [c for c in parts if least_child <= 1 or count_words(c) >= least_child] or parts))
                    used += len(p) + sum(map(len, parts))
                if used > FLUSH:
                    yield made(batch, rows)
                    rows, used = [], 0
            if rows:
                yield made(batch, rows)

    rows = df.select(key, text).mapInArrow(run, f"{key} {kind}, parent_idx int, parent string, children array<string>")
    return rows.select(key, "parent_idx", "parent", F.posexplode("children").alias("child_idx", "text")).select(key, "parent_idx", "child_idx", "parent", "text")
