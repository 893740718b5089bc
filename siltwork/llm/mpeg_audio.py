"""MPEG audio columns: bytes carried in Layer III streams, and the parser that reads them back.

encode() makes a legal MPEG-1 Layer III stream. Every frame is silent (its side information is zero and
checked by the frame's CRC-16) and carries payload in its ancillary bytes; the stream begins with an ID3v2.4
tag, whose PRIV frame holds the payload's length and CRC-32, and a Xing frame with the numbers of frames and
bytes and 100 seek points, and it ends with an ID3v1 tag. Frames are as large as the payload needs, so the
bit rate varies and the last frame is the smallest that fits.

parse() reads any MPEG-1, 2 or 2.5 stream of Layers I to III: it skips and reads tags, finds frame headers
again after foreign bytes (a header counts if a like one follows where its length says, or the stream ends
there), verifies the CRCs of Layer III, counts protected frames of Layers I and II as unverified, and reads Xing
or VBRI tables. Durations are exact: samples over sample rate.
"""

from __future__ import annotations

import binascii
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialised, need

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by bit rate index, Hz by sample rate index
KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

UNIT = 64  # payloads are padded with zero bytes to a positive multiple of this
OWNER = b"payload\0"
SIDE = 17  # bytes of side information in a mono MPEG-1 Layer III frame
HEAD = 4 + 2 + SIDE
ROOM = {i: 144 * KBPS[1, 3][i] * 1000 // 32000 - HEAD for i in range(1, 15)}  # at 32 kHz no frame needs padding


@dataclass(frozen=True)
class Header:
    version: int  # 1, or 2 for 2 and 2.5
    layer: int
    protected: bool
    kbps: int
    hz: int
    padding: int
    mono: bool
    samples: int
    size: int
    side: int

    @property
    def like(self) -> tuple:
        """What all frames of a stream share."""
        return self.version, self.layer, self.hz


@lru_cache(maxsize=4096)
def read_header(head: bytes) -> Header | None:
    """The four bytes as a frame header; None if they aren't one, or if the bit rate is free."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version_bits, layer_bits = head[1] >> 3 & 3, head[1] >> 1 & 3
    rate, hz = head[2] >> 4, head[2] >> 2 & 3
    if version_bits == 1 or layer_bits == 0 or rate in (0, 15) or hz == 3:
        return None
    version, layer = (1 if version_bits == 3 else 2), 4 - layer_bits
    kbps, hz, padding, mono = KBPS[version, layer][rate], HZ[version_bits][hz], head[2] >> 1 & 1, head[3] >> 6 == 3
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
    size = (12 * kbps * 1000 // hz + padding) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hz + padding
    side = 0 if layer != 3 else (17 if mono else 32) if version == 1 else (9 if mono else 17)
    return Header(version, layer, not head[1] & 1, kbps, hz, padding, mono, samples, size, side)


@lru_cache(maxsize=65536)
def crc16(covered: bytes) -> int:
    """CRC-16 of the standard: x^16 + x^15 + x^2 + 1, from all ones."""
    crc = 0xFFFF
    for byte in covered:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


@lru_cache(maxsize=32)
def _frame_head(rate: int) -> bytes:
    head = bytes((0xFF, 0xFA, rate << 4 | 2 << 2, 0xC4))  # MPEG-1, Layer III, CRC; 32 kHz; mono, original
    return head + struct.pack(">H", crc16(head[2:] + bytes(SIDE))) + bytes(SIDE)


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def encode(payload: bytes) -> bytes:
    """A Layer III stream that carries the payload, whose length is a positive multiple of UNIT."""
    frames, at = [], 0
    while at < len(payload):
        left = len(payload) - at
        rate = next((i for i in range(1, 15) if ROOM[i] >= left), 14)
        part = payload[at : at + ROOM[rate]]
        frames.append(_frame_head(rate) + part.ljust(ROOM[rate], b"\0"))
        at += ROOM[rate]
    sizes = [len(f) for f in frames]
    first = 144 * 48 * 1000 // 32000  # the Xing frame: 48 kbit/s
    total = first + sum(sizes)
    ends, table = [first], []
    for s in sizes:
        ends.append(ends[-1] + s)
    for percent in range(100):
        table.append(min(255, ends[min(len(sizes), percent * len(sizes) // 100)] * 256 // total))
    xing = b"Xing" + struct.pack(">III", 7, len(frames), total) + bytes(table)
    private = OWNER + struct.pack(">QI", len(payload), zlib.crc32(payload))
    tag = b"PRIV" + _synchsafe(len(private)) + b"\0\0" + private
    # the Xing frame has no CRC: its table stands where readers look for it, behind the side information
    opening = (bytes((0xFF, 0xFB, 3 << 4 | 2 << 2, 0xC4)) + bytes(SIDE) + xing).ljust(first, b"\0")
    return b"".join((b"ID3\4\0\0", _synchsafe(len(tag)), tag, opening, *frames, b"TAG".ljust(128, b"\0")))


@dataclass
class Stream:
    version: int = 0
    layer: int = 0
    hz: int = 0
    samples: int = 0
    offsets: list[int] = field(default_factory=list)  # of audio frames, for seeking
    sizes: list[int] = field(default_factory=list)
    rates: set[int] = field(default_factory=set)
    crc_right: int = 0
    crc_wrong: int = 0
    crc_unverified: int = 0  # protected frames of Layers I and II
    skipped: int = 0  # foreign bytes between frames
    resyncs: int = 0
    tags: list[str] = field(default_factory=list)
    private: dict[bytes, bytes] = field(default_factory=dict)
    table: dict | None = None  # of a Xing, Info or VBRI frame

    @property
    def duration(self) -> Fraction:
        return Fraction(self.samples, self.hz) if self.hz else Fraction(0)


def _variable_rate_table(data: bytes, at: int, h: Header) -> dict | None:
    for start in (at + 4 + h.side, at + 6 + h.side):
        kind = data[start : start + 4]
        if kind in (b"Xing", b"Info"):
            flags, p, out = int.from_bytes(data[start + 4 : start + 8]), start + 8, {"kind": kind.decode()}
            for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
                if flags & bit:
                    raw, p = data[p : p + size], p + size
                    out[name] = list(raw) if name == "toc" else int.from_bytes(raw)
            return out
    if data[at + 36 : at + 40] == b"VBRI" and len(data) >= at + 62:
        _, _, _, size, frames, entries, scale, width, per = struct.unpack(">HHHIIHHHH", data[at + 40 : at + 62])
        p = at + 62
        toc = [int.from_bytes(data[p + k * width : p + (k + 1) * width]) * scale for k in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc, "per_entry": per}
    return None


def _id3v2(data: bytes, at: int, s: Stream) -> int:
    """Reads the tag at `at`; the place behind it."""
    size = int.from_bytes(bytes([0]) + b"") if len(data) < at + 10 else sum((data[at + 6 + k] & 127) << 21 - 7 * k for k in range(4))
    major, flags = data[at + 3], data[at + 5]
    end = min(len(data), at + 10 + size + (10 if flags & 16 else 0))
    p, stop = at + 10, min(len(data), at + 10 + size)
    if flags & 64 and major >= 3:  # an extended header
        p += (sum((data[p + k] & 127) << 21 - 7 * k for k in range(4)) if major == 4 else int.from_bytes(data[p : p + 4]) + 4) if p + 4 <= stop else 0
    while major >= 3 and p + 10 <= stop and data[p]:
        length = sum((data[p + 4 + k] & 127) << 21 - 7 * k for k in range(4)) if major == 4 else int.from_bytes(data[p + 4 : p + 8])
        body = data[p + 10 : min(stop, p + 10 + length)]
        if data[p : p + 4] == b"PRIV" and b"\0" in body:
            cut = body.index(b"\0") + 1
            s.private[body[:cut]] = body[cut:]
        p += 10 + length
    s.tags.append(f"ID3v2.{major}")
    return end


def parse(data: bytes) -> Stream:
    """What the stream holds. Bytes without any frame give an empty Stream."""
    s, at, stop, like, lost = Stream(), 0, len(data), None, False
    if data[-128:-125] == b"TAG":
        stop -= 128
    while at < stop:
        if data[at : at + 3] == b"ID3" and at + 10 <= stop:
            at = _id3v2(data, at, s)
            continue
        h = read_header(data[at : at + 4])
        good = h is not None and at + h.size <= stop and (like is None or h.like == like)
        if good and (like is None or lost):  # confirmed by a like header behind it, or by the stream's end
            behind = at + h.size
            n = read_header(data[behind : behind + 4])
            good = behind >= stop or (n is not None and n.like == h.like) or data[behind : behind + 3] == b"ID3"
        if not good:
            if not lost and (like is not None or s.skipped == 0):
                s.resyncs += like is not None
            lost = True
            found = data.find(b"\xff", at + 1, stop)
            tag = data.find(b"ID3", at + 1, found if found >= 0 else stop)
            to = tag if tag >= 0 else found if found >= 0 else stop
            s.skipped, at = s.skipped + to - at, to
            continue
        lost = False
        first, like = like is None, h.like
        if first:
            s.version, s.layer, s.hz = h.version, h.layer, h.hz
        if first and h.layer == 3 and (t := _variable_rate_table(data, at, h)):
            s.table = t  # not a frame of audio
            at += h.size
            continue
        if h.protected and h.layer == 3:
            right = crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) == int.from_bytes(data[at + 4 : at + 6])
            s.crc_right, s.crc_wrong = s.crc_right + right, s.crc_wrong + (not right)
        elif h.protected:
            s.crc_unverified += 1
        s.offsets.append(at), s.sizes.append(h.size), s.rates.add(h.kbps)
        s.samples += h.samples
        at += h.size
    if stop < len(data):
        s.tags.append("ID3v1")
    return s


def carried(data: bytes, s: Stream | None = None) -> bytes:
    """The payload that encode() stored; an error if the stream lost any of it."""
    s = s or parse(data)
    length, crc = struct.unpack(">QI", s.private[OWNER])
    payload = b"".join(data[o + HEAD : o + n] for o, n in zip(s.offsets, s.sizes))[:length]
    if s.crc_wrong or len(payload) != length or zlib.crc32(payload) != crc:
        raise ValueError("the stream doesn't hold the payload that its tag describes")
    return payload


def feature(s: Stream) -> str:
    d, unverified = s.duration, f" unverified={s.crc_unverified}" if s.crc_unverified else ""
    return (
        f"mpeg{s.version}-layer{s.layer} {s.hz}Hz frames={len(s.offsets)} duration={d.numerator}/{d.denominator}s"
        f" kbps={min(s.rates, default=0)}-{max(s.rates, default=0)} crc={s.crc_right}/{s.crc_right + s.crc_wrong}{unverified} resyncs={s.resyncs}"
        f" skipped={s.skipped} tags={'+'.join(s.tags)} table={s.table['kind'] if s.table else 'none'}:{s.table.get('frames') if s.table else 0}"
    )


def media_column(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_bytes and media, the stream that carries the text's UTF-8 bytes padded with zeros to a multiple of UNIT.

    A null text is an empty one, whose payload is UNIT zero bytes. Ids may be null or repeat: rows stay rows.
    """
    need(df, id_column, text_column)
    source = df.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                sizes, media = [], []
                for t in batch.column(1).to_pylist():
                    sizes.append(len(t))
                    media.append(encode(t.ljust(max(UNIT, -(-len(t) // UNIT) * UNIT), b"\0")))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    return arrow_map(source, run, f"id {source.dtypes[0][1]}, n_bytes long, media binary")


def media_facts(media: DataFrame) -> DataFrame:
    """Rows of media_column() with what the stored bytes hold.

    Columns: id, n_bytes, the payload's length, SHA-256 and the CRC-32 of its last UNIT bytes, the stream's
    length and SHA-256, feature, the exact duration as samples and sample_rate, and the offset of each frame.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                rows = []
                for data in batch.column(2).to_pylist():
                    s = parse(data)
                    p = carried(data, s)
                    rows.append((len(p), hashlib.sha256(p).hexdigest(), binascii.crc32(p[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(s), s.samples, s.hz, s.offsets))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "samples", "sample_rate", "frame_offsets"]
    schema = (
        f"id {media.dtypes[0][1]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,"
        " media_sha256 string, feature string, samples long, sample_rate long, frame_offsets array<long>"
    )
    return arrow_map(media, run, schema)


def stored(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """media_facts of the media column as read back from the shared folder."""
    return media_facts(materialised(media_column(df, id_column, text_column), "media")).withColumnRenamed("id", id_column)
