"""Media columns: MPEG audio, written and read as bytes of a column.

Reading (any MPEG-1/2/2.5 stream, layers I to III): ID3v2 tags are parsed and
skipped, frame headers are followed one by one, and after bytes that are no
header the reader resynchronises on the next header that another of its kind (or
the end) follows. Checksums are verified in all layers (over the side information
of layer III, the bit allocation of layer I, allocation and scale-factor selection
of layer II), Xing/Info and VBRI tables parsed (their frame counts and seek points), an ID3v1 tag at the end recognised
unless a frame that is followed runs over its start and ends with another or the end.
Durations are exact: samples over sample rate, summed over the rates of a stream, as
a fraction; every frame's byte offset is a seek point and is stored.

Writing: a payload of 576-byte units becomes a valid layer III stream, a unit to
a frame (44.1 kHz mono, 192 kbit/s: 626 bytes), placed in the frame's ancillary
bytes behind an empty main-data section, so decoders play silence and no unit is
altered. An ID3v2 tag holds the payload's length and checksum, the first frame a
Xing table with 100 seek points.

Defined cases: a null text is an empty text and has one unit of bytes 255; equal
texts give equal media; null doc_ids and repeated rows pass through; bytes that
hold no frame have no frames, and duration 0; a stream that :func:`write` did not
make holds no payload, whatever its tags say; an empty table gives none; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

UNIT = 576
PAD = 255

# fixed values of the MPEG audio frame header: kbit/s by bit-rate index, Hz by rate index
KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    checked: bool
    kbps: int
    rate: int
    mono: bool
    bound: int  # subbands below it have a channel's own allocation each
    length: int
    samples: int

    @property
    def side_info(self) -> int:
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)

    @property
    def kind(self) -> tuple:
        return self.version, self.layer, self.rate


_headers: dict[int, Header | None] = {}


def header(word: int) -> Header | None:
    """The frame header in a big-endian 32-bit word, if it is a valid one."""
    if word >> 21 != 0x7FF:
        return None
    if word in _headers:
        return _headers[word]
    version = {0: 2.5, 2: 2, 3: 1}.get(word >> 19 & 3)
    layer = {1: 3, 2: 2, 3: 1}.get(word >> 17 & 3)
    bits, freq = word >> 12 & 15, word >> 10 & 3
    found = None
    if version and layer and 0 < bits < 15 and freq < 3 and word & 3 != 2:
        kbps, rate, pad = KBPS[1 if version == 1 else 2, layer][bits], HERTZ[version][freq], word >> 9 & 1
        samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
        length = (12000 * kbps // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // rate + pad
        mode = word >> 6 & 3
        bound = 0 if mode == 3 else 4 * (word >> 4 & 3) + 4 if mode == 1 else 32
        found = Header(version, layer, not word >> 16 & 1, kbps, rate, mode == 3, bound, length, samples)
    if len(_headers) < 4096:
        _headers[word] = found
    return found


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        t = np.where(t & 0x8000, (t << 1) ^ 0x8005, t << 1) & 0xFFFF
    return t.astype(np.uint32)


CRC = _crc_table()


def frame_checksums(raw: np.ndarray, at: np.ndarray, side: int) -> np.ndarray:
    """CRC-16 over each frame's last two header bytes and its side information."""
    crc = np.full(len(at), 0xFFFF, np.uint32)
    for k in (2, 3, *range(6, 6 + side)):
        crc = (crc << 8 & 0xFFFF) ^ CRC[(crc >> 8) ^ raw[at + k]]
    return crc


def allocation_bits(h: Header) -> list[int]:
    """Bits of each subband's allocation in layers I and II."""
    if h.layer == 1:
        return [4] * 32
    if h.version != 1:
        return [4] * 4 + [3] * 7 + [2] * 19
    each = h.kbps if h.mono else h.kbps // 2
    if each < 56:
        return [4] * 2 + [3] * (10 if h.rate == 32000 else 6)
    return [4] * 11 + [3] * 12 + [2] * (7 if each >= 96 and h.rate != 48000 else 4)


def bitwise_checksum(frame: bytes, h: Header) -> int:
    """CRC-16 of a layer I or II frame: the last two header bytes, the allocation
    and, in layer II, two bits for each subband and channel that has some."""
    value, total = int.from_bytes(frame), 8 * len(frame)
    take = lambda at, n: value >> max(0, total - at - n) & (1 << n) - 1
    at, used = 48, 0
    for band, bits in enumerate(allocation_bits(h)):
        if h.mono or band >= h.bound:
            used += bool(take(at, bits)) * (1 if h.mono else 2)
            at += bits
        else:
            used += bool(take(at, bits)) + bool(take(at + bits, bits))
            at += 2 * bits
    at += 2 * used * (h.layer == 2)
    crc = 0xFFFF
    for start, stop in ((16, 32), (48, at)):
        for k in range(start, stop):
            crc = (crc << 1) ^ (0x8005 if (crc >> 15 ^ take(k, 1)) & 1 else 0)
            crc &= 0xFFFF
    return crc


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    frames: list[int] = field(default_factory=list)  # offsets of audio frames
    heads: list[Header] = field(default_factory=list)
    skipped: int = 0  # bytes that belong to no tag, table or frame
    table: str = ""  # Xing, Info or VBRI
    table_frames: int = -1
    table_points: int = 0
    table_entries: tuple[int, ...] = ()  # as stored
    checked: int = 0
    damaged: int = 0

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.heads)

    @property
    def duration(self) -> tuple[int, int]:
        """Seconds as a reduced fraction; where the rate changes, as it can where
        streams were joined, each frame counts at its own."""
        by_rate: dict[int, int] = {}
        for h in self.heads:
            by_rate[h.rate] = by_rate.get(h.rate, 0) + h.samples
        total = sum((Fraction(n, rate) for rate, n in by_rate.items()), Fraction(0))
        return total.numerator, total.denominator


def _id3v2(data: bytes, at: int, out: Stream) -> int:
    """Parses a tag; returns its end, or ``at`` if there is none."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or max(data[at + 6 : at + 10]) > 127:
        return at
    seven = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    major, flags = data[at + 3], data[at + 5]
    end = at + 10 + seven(data[at + 6 : at + 10])
    p = at + 10
    while p + 10 <= min(end, len(data)) and data[p]:
        name = data[p : p + 4].decode("latin-1")
        size = seven(data[p + 4 : p + 8]) if major == 4 else int.from_bytes(data[p + 4 : p + 8])
        body = data[p + 10 : min(p + 10 + size, end)]
        if name.startswith("T") and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace").rstrip("\0")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            out.tags[f"TXXX:{key}" if name == "TXXX" else name] = value
        p += 10 + size
    return min(end + (10 if flags & 0x10 else 0), len(data))


def _table(data: bytes, at: int, h: Header, out: Stream) -> bool:
    """Whether the frame holds a variable-bit-rate table instead of sound."""
    p = at + 4 + 2 * h.checked + h.side_info
    if data[p : p + 4] in (b"Xing", b"Info") and len(data) >= p + 8:
        out.table, flags, p = data[p : p + 4].decode(), int.from_bytes(data[p + 4 : p + 8]), p + 8
        if flags & 1:
            out.table_frames, p = int.from_bytes(data[p : p + 4]), p + 4
        p += 4 * bool(flags & 2)
        if flags & 4:
            out.table_points, out.table_entries = 100, tuple(data[p : p + 100])
        return True
    if data[at + 36 : at + 40] == b"VBRI" and len(data) >= at + 62:
        out.table, out.table_frames = "VBRI", int.from_bytes(data[at + 50 : at + 54])
        out.table_points = int.from_bytes(data[at + 54 : at + 56])
        size = int.from_bytes(data[at + 58 : at + 60])
        raw = data[at + 62 : min(at + 62 + out.table_points * size, at + h.length)]
        out.table_entries = tuple(int.from_bytes(raw[i : i + size]) for i in range(0, len(raw) - size + 1, size)) if size else ()
        return True
    return False


def parse(data: bytes) -> Stream:
    """Reads a stream; see the module's text."""
    out, end = Stream(), len(data)
    v1 = end - 128 if end >= 128 and data[end - 128 : end - 125] == b"TAG" else end
    at, synced, first = 0, None, True
    word = lambda p: int.from_bytes(data[p : p + 4])
    while at < end:
        if at == v1:
            out.tags["ID3v1"] = data[at + 3 : at + 33].rstrip(b"\0 ").decode("latin-1")
            break
        if (tag := _id3v2(data, at, out)) > at:
            at = tag
            continue
        h = header(word(at)) if at + 4 <= end else None
        if h is None or at + h.length > end:
            h = None
        elif h.kind != synced or at < v1 < at + h.length:  # a header counts once another of its kind follows it
            nxt = at + h.length
            follows = header(word(nxt)) if nxt + 4 <= end else None
            if not (nxt in (v1, end) or follows and follows.kind == h.kind or data[nxt : nxt + 3] == b"ID3"):
                h = None
        if h is None:
            stop = v1 if at < v1 else end
            nxt = data.find(b"\xff", at + 1, stop)
            nxt = stop if nxt < 0 else nxt
            out.skipped += nxt - at
            at, synced = nxt, None
            continue
        synced = h.kind
        if not (first and _table(data, at, h, out)):
            out.frames.append(at)
            out.heads.append(h)
        first = False
        at += h.length
    raw = np.frombuffer(data, np.uint8)
    for at, h in zip(out.frames, out.heads, strict=True):
        if h.checked and h.layer != 3:
            out.checked += 1
            out.damaged += bitwise_checksum(data[at : at + h.length], h) != int.from_bytes(data[at + 4 : at + 6])
    checked = np.array([i for i, h in enumerate(out.heads) if h.checked and h.layer == 3], int)
    out.checked += len(checked)
    if len(checked):
        offsets = np.array(out.frames)[checked]
        sides = np.array([out.heads[i].side_info for i in checked])
        for side in np.unique(sides):
            a = offsets[sides == side]
            stored = raw[a + 4].astype(np.uint32) << 8 | raw[a + 5]
            out.damaged += int((stored != frame_checksums(raw, a, int(side))).sum())
    return out


#: Layer III, 44.1 kHz, mono, 192 kbit/s, checksum present.
_WORD = 0xFFFA_B0C0
_HEAD = header(_WORD)
_AT = 6 + _HEAD.side_info  # where a unit lies in its frame


def _frame() -> np.ndarray:
    f = np.zeros(_HEAD.length, np.uint8)
    f[:4] = np.frombuffer(struct.pack(">I", _WORD), np.uint8)
    crc = int(frame_checksums(f, np.zeros(1, int), _HEAD.side_info)[0])
    f[4], f[5] = crc >> 8, crc & 255
    return f


_EMPTY = _frame()


def _text_frame(name: str, text: str) -> bytes:
    body = b"\x03" + text.encode()
    return name.encode() + struct.pack(">IH", len(body), 0) + body


def write(payload: bytes, n_bytes: int) -> bytes:
    """The stream that holds a payload of whole units."""
    n = len(payload) // UNIT
    tag = _text_frame("TXXX", f"bytes\0{n_bytes}") + _text_frame("TXXX", f"crc32\0{zlib.crc32(payload):08x}")
    size = len(tag)
    tag = b"ID3\x03\0\0" + bytes((size >> s) & 127 for s in (21, 14, 7, 0)) + tag
    info = _EMPTY.copy()
    table = b"Xing" + struct.pack(">III", 7, n, (n + 1) * _HEAD.length) + bytes(i * 256 // 100 for i in range(100))
    info[_AT : _AT + len(table)] = np.frombuffer(table, np.uint8)
    frames = np.tile(_EMPTY, (n, 1))
    frames[:, _AT : _AT + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    return tag + info.tobytes() + frames.tobytes()


def payload(data: bytes, s: Stream) -> bytes:
    """The units that a stream made by :func:`write` holds; of any other, none."""
    if any(h != _HEAD for h in s.heads):
        return b""
    raw = np.frombuffer(data, np.uint8)
    at = np.array(s.frames, int)
    return raw[at[:, None] + np.arange(_AT, _AT + UNIT)].tobytes() if len(at) else b""


def padded(text: bytes) -> bytes:
    return text + bytes([PAD]) * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, media: every text's bytes as an MPEG audio stream."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                media = [write(padded(t), len(t)) for t in ((x or "").encode() for x in s.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, media binary")


PARSED = (
    "doc_id long, media_bytes long, media_sha256 string, tags map<string,string>, n_frames long, seconds_num long, seconds_den long, "
    "kbps_low int, kbps_high int, vbr_table string, vbr_frames long, crc_checked long, crc_damaged long, skipped_bytes long, "
    "seek_sha256 string, seek array<long>, payload_bytes long, payload_sha256 string, payload_crc32 long, tail_crc32 long"
)


def parsed(media: DataFrame, seek: bool = True) -> DataFrame:
    """What the streams in column ``media`` hold; ``seek`` lists every frame's
    byte offset (their digest is there in any case)."""
    schema = PARSED if seek else PARSED.replace("seek array<long>, ", "")
    names = [f.split()[0] for f in schema.split(", ")]

    def row(doc_id, data):
        s = parse(data)
        held = payload(data, s) if "TXXX:bytes" in s.tags else b""
        kbps = [h.kbps for h in s.heads] or [0]
        offsets = np.array(s.frames, "<i8")
        num, den = s.duration
        out = [doc_id, len(data), hashlib.sha256(data).hexdigest(), list(s.tags.items()), len(s.frames), num, den, min(kbps), max(kbps), s.table, s.table_frames, s.checked, s.damaged, s.skipped, hashlib.sha256(offsets.tobytes()).hexdigest()]
        out += [offsets] if seek else []
        return out + [len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held), zlib.crc32(held[-32:])]

    def run(batches):
        types = None
        for b in batches:
            types = types or _arrow_types(schema)
            for at in range(0, b.num_rows, 128):
                s = b.slice(at, 128)
                rows = [row(i, m or b"") for i, m in zip(s.column(0).to_pylist(), s.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return media.select("doc_id", "media").mapInArrow(run, schema)


def _arrow_types(schema: str) -> list[pa.DataType]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "map<string,string>": pa.map_(pa.string(), pa.string()), "array<long>": pa.list_(pa.int64())}
    return [kinds[f.split(" ")[1]] for f in schema.split(", ")]


def audio_features(docs: DataFrame) -> DataFrame:
    """Store every text as audio, read the stored bytes back, and report; with the
    duration and the byte offset of every frame."""
    stored = materialize(media_column(docs), "media")
    p = parsed(stored)
    feature = F.concat_ws(
        ";",
        *[
            F.concat(F.lit(f"{k}="), v.cast("string"))
            for k, v in {
                "frames": F.col("n_frames"),
                "seconds": F.concat_ws("/", "seconds_num", "seconds_den"),
                "kbps": F.concat_ws("-", "kbps_low", "kbps_high"),
                "table": F.concat_ws(":", "vbr_table", "vbr_frames"),
                "crc": F.concat_ws("/", F.col("crc_checked") - F.col("crc_damaged"), "crc_checked"),
                "payload_ok": F.col("tags")["TXXX:crc32"] == F.lpad(F.lower(F.hex("payload_crc32")), 8, "0"),
                "skipped": F.col("skipped_bytes"),
                "seek": F.col("seek_sha256"),
            }.items()
        ],
    )
    return p.select("doc_id", F.col("tags")["TXXX:bytes"].cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "seconds_num", "seconds_den", "seek")
