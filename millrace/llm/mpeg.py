"""MPEG audio as a media column.

``pack`` carries any bytes losslessly in a legal stream: an ID3v2 tag with their number and checksum, a Xing
header frame with its seek table, and MPEG-1 layer III frames (48 kHz, one
channel, checksummed) whose granules are silent, so that all of a frame's main
data is ancillary data. A frame carries 192, 384, 576 or 768 payload bytes, the
format's unit here being 192 bytes; its bitrate tells which.

``parse`` reads any MPEG-1/2/2.5 stream, layers I to III: it skips and parses
tags (ID3v2 with text frames in front; ID3v1 and APEv2 only behind the last frame, so that no frame's bytes are taken
for a tag), resynchronises on frame headers after damage, reads Xing/Info and VBRI headers, verifies checksums (layers I and
III; layer II protects a span that depends on its allocation tables and is
counted as not verified), and returns exact durations (samples over sample rate)
and the byte offset of every frame, for seeking.

``unpack`` gives the carried bytes back. Null and empty texts carry one unit of spaces; very long ones have as many
frames as they need, in one value. Repeated rows and equal texts have equal values; an empty table gives no rows. Bytes that
are no MPEG audio parse to zero frames; free-format frames are not accepted. The columns ``media`` and ``info`` are
replaced where the input has them, all others are kept.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT = 192
TAIL = 16

# Fixed values of the format, in kbit/s and Hz (ISO/IEC 11172-3, 13818-3).
BITRATES = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {10: [44100, 48000, 32000], 20: [22050, 24000, 16000], 25: [11025, 12000, 8000]}


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        c = byte << 8
        for _ in range(8):
            c = (c << 1) ^ (0x8005 if c & 0x8000 else 0)
        table.append(c & 0xFFFF)
    return table


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    """The checksum of MPEG audio: polynomial 0x8005, from 0xFFFF."""
    c = 0xFFFF
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ _CRC[(c >> 8) ^ b]
    return c


@dataclass(frozen=True)
class Header:
    version: int  # 10, 20 or 25
    layer: int
    protected: bool
    rate: int
    bitrate: int
    channels: int
    mode: int
    extension: int
    size: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of layer III side information."""
        if self.version == 10:
            return 17 if self.channels == 1 else 32
        return 9 if self.channels == 1 else 17

    def kind(self) -> tuple[int, int, int]:
        return self.version, self.layer, self.rate


_HEADERS: dict[bytes, Header | None] = {}


def header(raw: bytes) -> Header | None:
    """The header in four bytes, or None. There are few distinct ones, so they are kept."""
    try:
        return _HEADERS[raw]
    except KeyError:
        if len(_HEADERS) > 4096:
            _HEADERS.clear()
        found = _HEADERS[raw] = _header(raw)
        return found


def _header(raw: bytes) -> Header | None:
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version = {0: 25, 2: 20, 3: 10}.get(raw[1] >> 3 & 3)
    layer = 4 - (raw[1] >> 1 & 3)
    b, r = raw[2] >> 4, raw[2] >> 2 & 3
    if version is None or layer == 4 or b in (0, 15) or r == 3 or raw[3] & 3 == 2:
        return None
    bitrate = BITRATES[1 if version == 10 else 2, layer][b]
    rate = RATES[version][r]
    padding = raw[2] >> 1 & 1
    if layer == 1:
        samples, size = 384, (12000 * bitrate // rate + padding) * 4
    else:
        samples = 576 if layer == 3 and version != 10 else 1152
        size = samples // 8 * 1000 * bitrate // rate + padding
    mode = raw[3] >> 6
    return Header(version, layer, not raw[1] & 1, rate, bitrate, 1 if mode == 3 else 2, mode, raw[3] >> 4 & 3, size, samples)


def _protected_bytes(h: Header) -> int | None:
    """How many bytes behind the checksum it covers; None where that is not known."""
    if h.layer == 3:
        return h.side
    if h.layer == 1:
        bound = 4 * (h.extension + 1) if h.mode == 1 else 32
        return (bound * h.channels + (32 - bound)) * 4 // 8
    return None


@dataclass
class Audio:
    tags: dict[str, str] = field(default_factory=dict)
    tag_kinds: list[str] = field(default_factory=list)
    vbr: str = ""
    vbr_frames: int = 0
    vbr_bytes: int = 0
    toc: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    channels: int = 0
    version: int = 0
    layer: int = 0
    crc_good: int = 0
    crc_bad: int = 0
    crc_unknown: int = 0
    resyncs: int = 0
    skipped: int = 0


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _to_syncsafe(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


_ENCODINGS = ["latin-1", "utf-16", "utf-16-be", "utf-8"]


def _id3v2(data: bytes, at: int, audio: Audio) -> int:
    """Parse the tag at ``at``; where it ends."""
    major, flags = data[at + 3], data[at + 5]
    end = at + 10 + _syncsafe(data[at + 6 : at + 10])
    body = data[at + 10 : end]
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    pos, wide = 0, 3 if major == 2 else 4
    if flags & 0x40 and len(body) >= 4:
        pos = _syncsafe(body[:4]) if major == 4 else int.from_bytes(body[:4], "big") + 4
    audio.tag_kinds.append(f"id3v2.{major}")
    while pos + 2 * wide <= len(body) and body[pos]:
        name = body[pos : pos + wide].decode("latin-1")
        raw = body[pos + wide : pos + 2 * wide]
        size = _syncsafe(raw) if major == 4 else int.from_bytes(raw, "big")
        pos += 6 if major == 2 else 10
        value = body[pos : pos + size]
        pos += size
        if name[0] == "T" and value and value[0] < 4:
            text = value[1:].decode(_ENCODINGS[value[0]], "replace").rstrip("\0")
            if name in ("TXXX", "TXX"):
                name, _, text = text.partition("\0")
            audio.tags.setdefault(name, text.lstrip("﻿"))
    return end + (10 if flags & 0x10 and major == 4 else 0)


def _trailing_tags(data: bytes, start: int, audio: Audio) -> int:
    """Where the tags (APEv2, ID3v1) that the stream ends with begin; nothing before ``start`` is taken for one."""
    end = len(data)
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        audio.tag_kinds.append("id3v1")
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            text = data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip()
            if text:
                audio.tags.setdefault(name, text)
    if end - start >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, count, flags = struct.unpack("<III", data[end - 20 : end - 8])
        first = end - size
        if size < 32 or first - (32 if flags & 0x80000000 else 0) < start:
            return end
        audio.tag_kinds.append("apev2")
        pos = first
        for _ in range(count):
            if pos + 8 > end - 32:
                break
            length = int.from_bytes(data[pos : pos + 4], "little")
            stop = data.find(b"\0", pos + 8, end)
            if stop < 0:
                break
            key = data[pos + 8 : stop].decode("latin-1")
            audio.tags.setdefault(key, data[stop + 1 : stop + 1 + length].decode("utf-8", "replace"))
            pos = stop + 1 + length
        end = first - (32 if flags & 0x80000000 else 0)
    return end


def _vbr_header(data: bytes, at: int, h: Header, audio: Audio) -> bool:
    """Whether the frame at ``at`` is a Xing/Info or VBRI header frame."""
    if h.layer != 3:
        return False
    for x in (at + 4 + h.side, at + 6 + h.side):
        kind = data[x : x + 4]
        if kind in (b"Xing", b"Info"):
            flags = int.from_bytes(data[x + 4 : x + 8], "big")
            pos = x + 8
            audio.vbr = kind.decode().lower()
            if flags & 1:
                audio.vbr_frames, pos = int.from_bytes(data[pos : pos + 4], "big"), pos + 4
            if flags & 2:
                audio.vbr_bytes, pos = int.from_bytes(data[pos : pos + 4], "big"), pos + 4
            if flags & 4:
                audio.toc = list(data[pos : pos + 100])
            return True
    x = at + 36
    if data[x : x + 4] == b"VBRI" and x + 26 <= at + h.size:  # one that its frame cuts off is none
        audio.vbr = "vbri"
        audio.vbr_bytes, audio.vbr_frames, entries, scale, width, _ = struct.unpack(">IIHHHH", data[x + 10 : x + 26])
        total = 0
        for k in range(min(entries, (at + h.size - x - 26) // width if width else 0)):
            audio.toc.append(total := total + scale * int.from_bytes(data[x + 26 + k * width : x + 26 + (k + 1) * width], "big"))
        return True
    return False


#: What a tag behind the frames begins with.
_TAGS = (b"TAG", b"APE")
_SUMS: dict[bytes, int] = {}


def _sum(covered: bytes) -> int:
    try:
        return _SUMS[covered]
    except KeyError:
        if len(_SUMS) > 4096:
            _SUMS.clear()
        found = _SUMS[covered] = crc16(covered)
        return found


def parse(data: bytes) -> Audio:
    """Read a stream: tags in front, frames, and only behind the last frame tags again, so that no frame is taken
    for a tag. Never raises on damaged bytes; counts what it had to skip."""
    audio, at, end = Audio(), 0, len(data)
    while data[at : at + 3] == b"ID3" and end >= at + 10:
        at = _id3v2(data, at, audio)
    kind, first, lost = None, True, False
    skipped: list[int] = []  # resynchronisations: where each began
    resumed = min(at, end)  # where the last frame ended
    while at + 4 <= end:
        h = header(data[at : at + 4])
        good = h is not None and at + h.size <= end and (kind is None or h.kind() == kind)
        if good and (kind is None or lost) and at + h.size < end:  # a lone header proves little
            after = header(data[at + h.size : at + h.size + 4])
            good = data[at + h.size : at + h.size + 3] in _TAGS or after is not None and after.kind() == h.kind()
        if not good:
            nxt = data.find(b"\xff", at + 1, end)
            if not lost:
                skipped.append(at)
            lost, at = True, end if nxt < 0 else nxt
            continue
        if lost:
            audio.skipped += at - skipped[-1]
            lost = False
        if kind is None:
            kind = h.kind()
            audio.version, audio.layer, audio.rate, audio.channels = h.version, h.layer, h.rate, h.channels
        if first and _vbr_header(data, at, h, audio):
            first, at = False, at + h.size
            resumed = at
            continue
        first = False
        if h.protected:
            span = _protected_bytes(h)
            if span is None:
                audio.crc_unknown += 1
            elif _sum(data[at + 2 : at + 4] + data[at + 6 : at + 6 + span]) == data[at + 4] << 8 | data[at + 5]:
                audio.crc_good += 1
            else:
                audio.crc_bad += 1
        audio.offsets.append(at)
        audio.samples += h.samples
        at += h.size
        resumed = at
    audio.resyncs = len(skipped)
    if resumed < end:  # what is behind the last frame: tags, and what is none was skipped
        rest = _trailing_tags(data, resumed, audio) - resumed
        audio.skipped += rest
        if lost and not rest:
            audio.resyncs -= 1
    return audio


#: Bitrate index for one to four units of payload in a frame; 48 kHz, so that a frame has three bytes per kbit/s.
_INDEX = {1: 6, 2: 10, 3: 12, 4: 14}
_SIDE = bytes(17)


def _head(units: int, protected: bool = True) -> bytes:
    return bytes([0xFF, 0xFA if protected else 0xFB, _INDEX[units] << 4 | 1 << 2, 0xC0])


_START = {u: (h := _head(u)) + crc16(h[2:4] + _SIDE).to_bytes(2, "big") + _SIDE for u in _INDEX}
_SIZE = {u: header(_head(u)).size for u in _INDEX}
_UNITS = {_SIZE[u]: u for u in _INDEX}
_LEAD = len(_START[1])


def padded(raw: bytes) -> bytes:
    """The payload: spaces are appended up to a positive multiple of the unit."""
    return raw + b" " * ((-len(raw)) % UNIT or (0 if raw else UNIT))


def _text_frame(name: str, value: str) -> bytes:
    text = f"\x03{name}\0{value}".encode()
    return b"TXXX" + _to_syncsafe(len(text)) + b"\0\0" + text


def pack(raw: bytes) -> bytes:
    """A stream that carries the padded bytes; equal bytes give equal streams."""
    payload = padded(raw)
    full, rest = divmod(len(payload), 4 * UNIT)
    frames = np.zeros((full, _SIZE[4]), np.uint8)
    frames[:, :_LEAD] = np.frombuffer(_START[4], np.uint8)
    frames[:, _LEAD : _LEAD + 4 * UNIT] = np.frombuffer(payload, np.uint8, full * 4 * UNIT).reshape(full, 4 * UNIT)
    body = frames.tobytes()
    if rest:
        u = rest // UNIT
        body += (_START[u] + payload[full * 4 * UNIT :]).ljust(_SIZE[u], b"\0")
    count = full + bool(rest)
    total = len(body) + _SIZE[4]
    starts = np.minimum(np.arange(100) * count // 100, full) * _SIZE[4] + _SIZE[4]
    toc = (starts * 256 // total).astype(np.uint8).tobytes()
    xing = (_head(4, False) + _SIDE + b"Xing" + struct.pack(">III", 7, count, total) + toc).ljust(_SIZE[4], b"\0")
    notes = b"".join(_text_frame(k, v) for k, v in (("payload-bytes", str(len(raw))), ("payload-crc32", f"{zlib.crc32(payload):08x}")))
    return b"ID3\x04\0\0" + _to_syncsafe(len(notes)) + notes + xing + body


def unpack(media: bytes, audio: Audio | None = None) -> bytes:
    """The padded bytes that a stream made by ``pack`` carries."""
    audio = audio or parse(media)
    out = []
    for at in audio.offsets:
        u = _UNITS[header(media[at : at + 4]).size]
        out.append(media[at + _LEAD : at + _LEAD + u * UNIT])
    return b"".join(out)


@F.arrow_udf(T.BinaryType())
def pack_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The stream that carries each text's bytes."""
    for batch in batches:
        yield pa.array([pack(x or b"") for x in batch.cast(pa.binary()).to_pylist()], pa.binary())


_FIELDS = {
    "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "frames": "long", "samples": "long",
    "rate": "long", "duration_s": "double", "crc_good": "long", "crc_bad": "long", "resyncs": "long", "tags": "string", "vbr": "string",
    "vbr_agrees": "boolean", "seek": "array", "feature": "string",
}
_SPARK = {"long": T.LongType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "array": T.ArrayType(T.LongType())}
_ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "array": pa.list_(pa.int64())}
MEDIA = pa.struct([(k, _ARROW[v]) for k, v in _FIELDS.items()])


def carried(media: bytes, a: Audio) -> tuple[int, bytes] | None:
    """How many bytes a stream made by ``pack`` carries, and the padded bytes; None if it is another, or damaged."""
    n = a.tags.get("payload-bytes", "")
    if not (n.isascii() and n.isdigit()) or a.crc_bad or a.resyncs or any(header(media[at : at + 4]).size not in _UNITS for at in a.offsets):
        return None
    payload = unpack(media, a)
    whole = len(payload) == -(-max(int(n), 1) // UNIT) * UNIT and f"{zlib.crc32(payload):08x}" == a.tags.get("payload-crc32")
    return (int(n), payload) if whole else None


def describe(media: bytes | None, strict: bool = False) -> dict:
    """What the media column stores about a stream; the payload is read back from it. One that carries none (any other
    audio, or damaged) has null ``n_bytes`` and an empty payload; ``strict`` raises instead."""
    media = media or b""
    a = parse(media)
    found = carried(media, a)
    if found is None and strict:
        raise ValueError(f"a stream of {len(media)} bytes does not give back what it should carry")
    n_bytes, payload = found or (None, b"")
    agrees = not a.vbr or a.vbr_frames == len(a.offsets)
    seconds = a.samples / a.rate if a.rate else 0.0
    feature = (
        f"mpeg{a.version / 10:g} layer{a.layer} {a.rate}Hz {a.channels}ch samples={a.samples} frames={len(a.offsets)} "
        f"crc={a.crc_good}/{a.crc_good + a.crc_bad + a.crc_unknown} resyncs={a.resyncs} vbr={a.vbr or '-'}{'' if agrees else '!'} tags={'+'.join(a.tag_kinds) or '-'}"
    )
    return {
        "n_bytes": n_bytes, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-TAIL:]), "frames": len(a.offsets), "samples": a.samples, "rate": a.rate, "duration_s": seconds,
        "crc_good": a.crc_good, "crc_bad": a.crc_bad, "resyncs": a.resyncs, "tags": "+".join(a.tag_kinds), "vbr": a.vbr,
        "vbr_agrees": agrees, "seek": a.offsets, "feature": feature,
    }


def _describer(strict: bool):
    @F.arrow_udf(T.StructType([T.StructField(k, _SPARK[v]) for k, v in _FIELDS.items()]))
    def describe_media(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([describe(x, strict) for x in batch.to_pylist()], MEDIA)

    return describe_media


def store(df: DataFrame, text: str | Column = "text", media: str = "media") -> DataFrame:
    """Add the media column that carries each text (null: empty). A column of that name is replaced."""
    return df.withColumn(media, pack_texts(text))


def index(df: DataFrame, media: str | Column = "media", info: str = "info", *, strict: bool = False) -> DataFrame:
    """Add the struct of what is read back from the media column. A column of that name is replaced. ``strict``: the
    column was made by ``store``, and a stream that does not read back as such ends the job."""
    return df.withColumn(info, _describer(strict)(media))
