import hashlib
import struct
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from halyard.llm import mpeg_audio as ma


def word(version=3, layer=1, crc=1, bits=9, freq=0, pad=0, mode=0):
    return 0xFFE00000 | version << 19 | layer << 17 | crc << 16 | bits << 12 | freq << 10 | pad << 9 | mode << 6


def frame(**k):
    w = word(**k)
    return struct.pack(">I", w).ljust(ma.header(w).length, b"\x11")


def test_headers():
    # length = samples/8 * bit rate / sample rate + padding, worked out by hand
    cases = {(3, 1, 9, 0, 0): (417, 1152), (3, 1, 9, 0, 1): (418, 1152), (3, 1, 9, 2, 0): (576, 1152), (2, 1, 8, 0, 0): (208, 576), (0, 1, 8, 0, 0): (417, 576), (3, 2, 10, 1, 0): (576, 1152), (3, 3, 12, 1, 1): (388, 384), (2, 3, 4, 2, 0): (192, 384)}
    for (v, la, b, f, p), want in cases.items():
        h = ma.header(word(v, la, 1, b, f, p))
        assert (h.length, h.samples) == want, (v, la, b, f, p)
    assert not any(ma.header(w) for w in (0, word(1), word(3, 0), word(bits=0), word(bits=15), word(freq=3), word() | 2))


def test_resync_tags_and_variable_rates():
    id3 = b"ID3\x04\0\0\0\0\0\x13TIT2\0\0\0\x05\0\0\x03Song\0\0\0\0"
    frames = [frame(bits=9), frame(bits=11), frame(bits=5), frame(bits=9, pad=1)]
    junk = b"\xff\xfb\x90\x64 no frame \xff\xff\xe0"
    data = id3 + junk + frames[0] + frames[1] + b"\0\0junk" + frames[2] + frames[3] + b"TAG" + b"Old title".ljust(125, b"\0")
    s = ma.parse(data)
    assert s.tags == {"TIT2": "Song", "ID3v1": "Old title"}
    starts, p = [], len(id3) + len(junk)
    for k, f in enumerate(frames):
        p += 6 * (k == 2)
        starts.append(p)
        p += len(f)
    assert s.frames == starts and s.skipped == len(junk) + 6
    assert [h.kbps for h in s.heads] == [128, 192, 64, 128]
    assert s.samples == 4 * 1152 and s.duration == (4 * 1152 // 36, 44100 // 36)


def test_tables_and_checksums():
    vbri = bytearray(frame())
    vbri[36:62] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 0, 9999, 77, 5, 1, 2, 1)
    s = ma.parse(bytes(vbri) + frame() * 3)
    assert (s.table, s.table_frames, s.table_points, len(s.frames)) == ("VBRI", 77, 5, 3)
    data = bytearray(ma.write(ma.padded(b"abc" * 1000), 3000))
    s = ma.parse(bytes(data))
    assert (s.table, s.table_frames, s.table_points, len(s.frames), s.checked, s.damaged) == ("Xing", 6, 100, 6, 6, 0)
    data[s.frames[2] + 8] ^= 1  # side information
    assert ma.parse(bytes(data)).damaged == 1
    assert ma.parse(b"").frames == [] and ma.parse(b"\xff" * 50).duration == (0, 1)


def plain_crc(bits):
    """Remainder of the polynomial division, on a string of bits."""
    reg = [1] * 16
    for b in bits:
        top = reg[0] ^ int(b)
        reg = [*reg[1:], 0]
        if top:
            reg = [x ^ y for x, y in zip(reg, map(int, f"{0x8005:016b}"), strict=True)]
    return int("".join(map(str, reg)), 2)


def test_checksums_of_layers_one_and_two():
    rng = np.random.default_rng(2)
    # version, layer, rate index, bit-rate index, mode bits -> allocation bits by subband (channel's own below the bound)
    cases = [
        (3, 3, 0, 9, 0, [8] * 32),
        (3, 3, 1, 9, 3, [4] * 32),
        (3, 3, 2, 9, 1, [8] * 4 + [4] * 28),
        (3, 2, 0, 10, 0, [8] * 11 + [6] * 12 + [4] * 7),  # 192 kbit/s stereo
        (3, 2, 1, 10, 0, [8] * 11 + [6] * 12 + [4] * 4),
        (3, 2, 0, 2, 3, [4] * 2 + [3] * 6),  # 48 kbit/s mono
        (3, 2, 2, 2, 3, [4] * 2 + [3] * 10),
        (2, 2, 0, 8, 3, [4] * 4 + [3] * 7 + [2] * 19),
    ]
    for version, layer, freq, bits, mode, allocation in cases:
        w = word(version, layer, 0, bits, freq, 0, mode)
        h = ma.header(w)
        zero = bytearray(struct.pack(">I", w).ljust(h.length, b"\0"))
        s = "".join(f"{b:08b}" for b in zero)
        assert ma.bitwise_checksum(bytes(zero), h) == plain_crc(s[16:32] + s[48 : 48 + sum(allocation)])
        f = bytearray(struct.pack(">I", w) + rng.integers(0, 256, h.length - 4, np.uint8).tobytes())
        s, at, used = "".join(f"{b:08b}" for b in f), 48, 0
        for n in allocation:
            own = 1 if mode == 3 or n <= 4 and mode != 0 else 2
            for part in range(own):
                on = int(s[at + part * n // own : at + (part + 1) * n // own], 2) > 0
                used += on * (1 if own == 2 or mode == 3 else 2)
            at += n
        crc = plain_crc(s[16:32] + s[48 : at + (2 * used if layer == 2 else 0)])
        assert ma.bitwise_checksum(bytes(f), h) == crc
        f[4:6] = struct.pack(">H", crc)
        got = ma.parse(bytes(f) * 3)
        assert (got.checked, got.damaged) == (3, 0)
        f[3] ^= 0x08  # the copyright bit
        assert ma.parse(bytes(f) * 3).damaged == 3


def test_joined_streams_of_two_rates():
    s = ma.parse(frame(freq=0) * 3 + frame(freq=2) * 2)
    assert Fraction(*s.duration) == Fraction(3 * 1152, 44100) + Fraction(2 * 1152, 32000)


def test_foreign_streams_hold_no_payload(spark):
    tag = ma._text_frame("TXXX", "bytes\0many")
    data = b"ID3\x03\0\0" + bytes((len(tag) >> s) & 127 for s in (21, 14, 7, 0)) + tag + frame() * 3
    row = ma.parsed(spark.createDataFrame([(1, bytearray(data)), (2, None)], "doc_id long, media binary")).orderBy("doc_id").collect()
    assert (row[0]["payload_bytes"], row[0]["n_frames"], row[0]["tags"]["TXXX:bytes"]) == (0, 3, "many")
    assert list(row[0]["seek"]) == [len(data) - 3 * 417 + i * 417 for i in range(3)] and row[1]["n_frames"] == 0


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000))
def test_round_trip(text):
    media = ma.write(ma.padded(text), len(text))
    s = ma.parse(media)
    assert ma.payload(media, s) == ma.padded(text) and s.skipped == 0
    assert s.duration[0] * 44100 == s.duration[1] * 1152 * len(s.frames)


def test_features(spark):
    texts = [None, "", "a" * 576, "é" * 288 + "x", "\xff\xfbÿ" * 40_000, "same", "same", "ID3 TAG Xing VBRI"]
    rows = [(i if i != 6 else None, t, "m") for i, t in enumerate(texts)]
    out = ma.audio_features(spark.createDataFrame(rows, "doc_id long, text string, media string")).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    for i, t, _ in rows:
        raw = (t or "").encode()
        held = raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
        r = by[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(held))
        assert (r["payload_sha256"], r["tail_crc32"]) == (hashlib.sha256(held).hexdigest(), zlib.crc32(held[-32:]))
        media = ma.write(held, len(raw))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert f"frames={len(held) // 576};" in r["feature"] and "payload_ok=true" in r["feature"] and "skipped=0" in r["feature"]
    assert by[5]["feature"] == by[None]["feature"]
    assert ma.audio_features(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    seek = ma.parsed(ma.media_column(spark.createDataFrame(rows[:1], "doc_id long, text string, m string"))).first()
    assert len(seek["seek"]) == seek["n_frames"] == 1 and seek["seek"][0] > 626


def test_tag_inside_a_unit_is_no_id3v1():
    unit = b"a" * 475 + b"TAG" + b"b" * 98
    data = ma.write(unit, 576)
    s = ma.parse(data)
    assert data[-128:-125] == b"TAG" and len(s.frames) == 1 and ma.payload(data, s) == unit and "ID3v1" not in s.tags
    tagged = ma.parse(data + b"TAG" + b"Title".ljust(125, b"\0"))
    assert (len(tagged.frames), tagged.skipped, tagged.tags["ID3v1"]) == (1, 0, "Title")
    junk = ma.parse(data + b"junk" + b"TAG" + b"Title".ljust(125, b"\0"))
    assert (len(junk.frames), junk.skipped, junk.tags["ID3v1"]) == (1, 4, "Title")


def test_table_entries_are_read():
    assert ma.parse(ma.write(bytes(576), 576)).table_entries == tuple(i * 256 // 100 for i in range(100))
    f = bytearray(frame())
    f[36:68] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 0, 0, 9, 3, 1, 2, 4) + struct.pack(">HHH", 300, 5, 70)
    assert ma.parse(bytes(f) + frame() + frame()).table_entries == (300, 5, 70)
