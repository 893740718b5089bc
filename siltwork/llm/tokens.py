"""Tokenising whole texts by cached pre-tokens.

Both kinds of vocabulary cut a text into pre-tokens before they merge, so its ids are those of its
pre-tokens, one after another. A text of plain characters (PLAIN) is cut here; its pre-tokens' ids come
from the worker's cache, and only new ones go to the merge model. Any other text goes to the tokenizer
whole. The cache takes CACHE pre-tokens, which the frequent ones soon are, and then no more. Tests compare
the ids with the tokenizers' own.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable

import numpy as np

CACHE = 150_000  # some 35 MB in each worker

#: Latin letters whose lower case is one letter and which NFC leaves alone (fixed by Unicode)
UPPER = "A-ZÀ-ÖØ-Þ"
LOWER = "a-zß-öø-įĳ-ľł-ňŋ-ž"
MIXED = "Ā-įĲ-ľŁ-ňŊ-ž"
#: printable ASCII but letters and digits; the apostrophe begins contractions and < special tokens
MARKS = re.escape("!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~")
NOT_PLAIN = re.compile(f"[^ \t\n\r0-9{UPPER}{LOWER}{MIXED}{MARKS}]")


class Cached(dict):
    """ids of pre-tokens as little-endian bytes; make() gives those of a new one."""

    def __init__(self, make: Callable[[str], list[int]], wide: bool):
        super().__init__()
        self.make, self.code = make, "I" if wide else "H"

    def __missing__(self, piece: str) -> bytes:
        ids = array(self.code, self.make(piece)).tobytes()
        if len(self) < CACHE:
            self[piece] = ids
        return ids


class WordBpe:
    """tokenizers' encode(text, add_special_tokens=False) for a lower-casing BPE file that drops white space."""

    PIECES = re.compile(f"[{LOWER}]+|[0-9]|[{MARKS}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        # the byte-level alphabet: printable Latin-1 bytes stand for themselves, others for 256 and up in order
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        alphabet = [chr(b) if b in printable else chr(next(rest)) for b in range(256)]

        def merge(piece: str) -> list[int]:
            shown = piece if piece.isascii() else "".join([alphabet[b] for b in piece.encode()])
            return [t.id for t in model.tokenize(shown)]

        self.pieces = Cached(merge, self.kind.itemsize == 4)

    def encode(self, text: bytes) -> np.ndarray:
        s = text.decode("utf-8", "replace")
        if NOT_PLAIN.search(s):
            return np.array(self.tokenizer.encode(s, add_special_tokens=False).ids, dtype=self.kind)
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, self.PIECES.findall(s.lower()))), dtype=self.kind)


class ByteBpe:
    """tiktoken's encode_ordinary for a rank file and its split pattern; loses no byte of valid UTF-8."""

    PIECES = re.compile(f" ?[{UPPER}{LOWER}{MIXED}]+| ?[0-9]+| ?[{MARKS}]+|\\s")
    RUNS = re.compile(r"\s\s|\s\Z")  # the pattern looks ahead in runs of white space

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 2  # one id is free for the end of a document
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.pieces = Cached(self.encoding.encode_ordinary, self.kind.itemsize == 4)

    def encode(self, text: bytes) -> np.ndarray:
        s = text.decode("utf-8", "replace")
        if NOT_PLAIN.search(s) or self.RUNS.search(s):
            return np.array(self.encoding.encode_ordinary(s), dtype=self.kind)
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, self.PIECES.findall(s))), dtype=self.kind)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.encoding.decode_bytes([int(i) for i in ids])


_loaded: dict = {}


def load(kind: str, path: str, pattern: str = "") -> WordBpe | ByteBpe:
    """The worker's tokenizer for a file; made once in each worker."""
    key = (kind, path, pattern)
    if key not in _loaded:
        _loaded[key] = WordBpe(path) if kind == "word" else ByteBpe(path, pattern)
    return _loaded[key]
