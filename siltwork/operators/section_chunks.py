"""Structural chunking as a table function over a document's elements, partitioned by document and ordered by position.

A section's elements are packed into parents by the budget of its role; a parent is cut into children at words, by tokens
and by characters. Tables stand for themselves: with a summary as one parent and a child that holds the summary, else whole, else as
bands of rows. A task holds one section of one document.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunking import SPACE, WORD, count_words, sections

# Parent tokens, child tokens and overlap of each role; roles that are left out; least child and last child; characters of a chunk
PROFILES = {
    "abstract": (400, 400, 0), "intro": (1000, 512, 75), "related": (1000, 512, 50), "method": (1200, 768, 150), "results": (1000, 512, 50), "discussion": (1000, 640, 100),
    "limitations": (800, 512, 50), "future": (600, 400, 25), "conclusion": (400, 400, 0), "body": (1000, 512, 50),
}
DROPPED = ("references", "acknowledg", "toc")
LEAST_CHILD, SHORT_CHILD, CHARACTERS = 50, 150, 8000


def returned(doc: str) -> str:
    return f"doc {doc}, parent_idx INT, child_idx INT, role STRING, breadcrumb STRING, modality STRING, text STRING"


def children(text: str, budget: int, overlap: int, characters: int) -> list[str]:
    """Runs of words within `budget` words and `characters` characters; each but the first begins with the last words before it, `overlap` at most."""
    out: list[str] = []
    held: list[str] = []
    size = fresh = 0
    for word in WORD.findall(text):
        grown = size + len(word) + bool(held)
        if held and (len(held) + 1 > budget or grown > characters):
            if fresh:
                out.append(" ".join(held))
            held = held[len(held) - min(overlap, len(held)) :] if overlap else []
            size, fresh = len(" ".join(held)), 0
            grown = size + len(word) + bool(held)
        held.append(word)
        size, fresh = grown, fresh + 1
    return [*out, " ".join(held)] if fresh else out


def bands(table: str, budget: int) -> list[str]:
    """A Markdown table's rows in bands of at most `budget` characters, the two header lines repeated; a longer row is cut."""
    lines = table.split("\n")
    head, room = lines[:2], max(1, budget - sum(len(h) + 1 for h in lines[:2]))
    rows = [r[i : i + room] for r in lines[2:] for i in range(0, max(1, len(r)), room)]
    out, held, used = [], [], 0
    for r in rows:
        if held and used + len(r) + 1 > room:
            out.append("\n".join([*head, *held]))
            held, used = [], 0
        held.append(r)
        used += len(r) + 1
    return [*out, "\n".join([*head, *held])]


class SectionChunks:
    """Rows (doc, pos, section, role, breadcrumb, type, text, caption, summary) of one document as its chunks.

    A parent has a number; its children are numbered from 0, a table without a summary has none (null). Children below LEAST_CHILD tokens go;
    a last child below SHORT_CHILD joins the one before. Null texts are empty, roles of no profile are body.
    """

    limits = CHARACTERS, LEAST_CHILD, SHORT_CHILD

    def __init__(self):
        self.doc = self.key = self.role = self.breadcrumb = None
        self.held: list[str] = []
        self.used, self.parent = 0, 0

    def eval(self, row) -> Iterator[tuple]:
        self.doc = row["doc"]
        key = (row["section"], row["role"], row["breadcrumb"])
        if key != self.key:
            yield from self._flush()
            self.key, self.role, self.breadcrumb = key, row["role"] or "body", row["breadcrumb"] or ""
        if self.role in DROPPED:
            return
        text = (row["text"] or "").strip(SPACE)
        if row["type"] == "table":
            yield from self._flush()
            yield from self._table(text, (row["caption"] or "").strip(SPACE), (row["summary"] or "").strip(SPACE))
        elif text:
            n = count_words(text)
            if self.held and self.used + n > PROFILES.get(self.role, PROFILES["body"])[0]:
                yield from self._flush()
            self.held.append(text)
            self.used += n

    def terminate(self) -> Iterator[tuple]:
        yield from self._flush()

    def _prefix(self) -> str:
        return f"[{self.breadcrumb}]\n\n"

    def _row(self, child: int | None, role: str, modality: str, text: str) -> tuple:
        return self.doc, self.parent, child, role, self.breadcrumb, modality, self._prefix() + text

    def _flush(self) -> Iterator[tuple]:
        if not self.held:
            return
        _, budget, overlap = PROFILES.get(self.role, PROFILES["body"])
        characters, least, short = self.limits
        parts = children("\n\n".join(self.held), budget, overlap, characters - len(self._prefix()))
        self.held, self.used = [], 0
        size = count_words
        if len(parts) > 1 and size(parts[-1]) < short and size(parts[-2]) + size(parts[-1]) <= budget + short:
            last = parts.pop()
            parts[-1] += " " + last
        kept = [c for c in parts if size(c) >= least]
        for i, c in enumerate(kept):
            yield self._row(i, self.role, "text", c)
        self.parent += bool(kept)

    def _table(self, table: str, caption: str, summary: str) -> Iterator[tuple]:
        if "|" not in table:
            return
        room = self.limits[0] - len(self._prefix())
        whole = f"{caption}\n\n{table}" if caption else table
        if summary and len(summary) <= room:
            yield self._row(None, "table", "table", whole)
            yield self._row(0, "table", "table", summary)
            self.parent += 1
        elif len(whole) <= room:
            yield self._row(None, "table", "table", whole)
            self.parent += 1
        else:
            again = f"(continued — see {caption.split(':', 1)[0].strip()} above)" if caption else "(continued)"
            pieces = bands(table, max(200, room - max(len(caption), len(again)) - 18))
            for i, band in enumerate(pieces):
                head = f"{again if i else caption} (part {i + 1}/{len(pieces)})".strip()
                yield self._row(None, "table", "table", f"{head}\n\n{band}")
                self.parent += 1


class WordChunks(SectionChunks):
    """Chunks by words alone, however many characters they have."""

    limits = sys.maxsize, LEAST_CHILD, SHORT_CHILD


def chunks(elements: DataFrame, role: Column, maker: type[SectionChunks] = SectionChunks) -> DataFrame:
    """elements(doc, pos, type, text, text_level, caption, summary) as chunks; role is that of the heading in column heading.

    Sections, breadcrumbs and roles are columns; the table function sees a document's elements in order. maker cuts a document: SectionChunks within
    CHARACTERS, WordChunks without such a bound.
    """
    e = sections(elements).withColumn("heading", F.split("breadcrumb", " > ")[0]).withColumn("role", role)
    e = e.filter((F.col("type") == "table") | (F.col("text_level") == 0)).select("doc", "pos", "section", "role", "breadcrumb", "type", "text", "caption", "summary")
    make = F.udtf(maker, returnType=returned(e.schema["doc"].dataType.simpleString()))
    return make(e.asTable().partitionBy("doc").orderBy("pos"))
