"""MPEG audio media columns: bytes as Layer III frames, and a reader that resynchronises, verifies and seeks."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corviq.llm.common import bound_batches, rows_of, slices

UNIT = 576  # samples of a granule, bytes of payload in a frame
_V1 = ((0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320))
_V2 = ((0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), *[(0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)] * 2)
_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
_CRC = []
for _n in range(256):
    _c = _n << 8
    for _ in range(8):
        _c = (_c << 1 ^ 0x8005 if _c & 0x8000 else _c << 1) & 0xFFFF
    _CRC.append(_c)


@lru_cache(4096)
def crc16(data: bytes) -> int:
    crc = 0xFFFF
    for b in data:
        crc = (crc << 8 & 0xFFFF) ^ _CRC[crc >> 8 ^ b]
    return crc


def crc16_bits(data: bytes, bits: int) -> int:
    """Of the first ``bits`` bits, whole bytes or not."""
    crc = crc16(data[: bits // 8])
    for k in range(bits // 8 * 8, bits):
        one = data[k // 8] >> (7 - k % 8) & 1
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if one ^ crc >> 15 else 0)
    return crc


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG 1, 2: MPEG 2, 0: MPEG 2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    size: int
    samples: int
    bound: int = 32  # subbands below it have an allocation for each channel

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


@lru_cache(4096)
def header(four: bytes) -> Header | None:
    """The frame header in four bytes; None if they are none (free format isn't read)."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    kbit, rate = four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or kbit in (0, 15) or rate == 3 or four[3] & 3 == 2:
        return None
    kbps, hz, pad = (_V1 if version == 3 else _V2)[layer - 1][kbit], _RATES[version][rate], four[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    size = (12000 * kbps // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + pad
    joint = four[3] >> 6 == 1 and layer < 3
    return Header(version, layer, not four[1] & 1, kbps, hz, four[3] >> 6 == 3, size, samples, 4 * (1 + (four[3] >> 4 & 3)) if joint else 32)


#: Layer II: for each run of subbands, how many there are and how many bits their allocation has.
_ALLOCATION = {"a": ((11, 4), (12, 3), (4, 2)), "b": ((11, 4), (12, 3), (7, 2)), "c": ((2, 4), (6, 3)), "d": ((2, 4), (10, 3)), "low": ((4, 4), (7, 3), (19, 2))}


def _allocation(h: Header) -> list[int]:
    """Bits of each subband's allocation in a Layer II frame: the tables hang on rate and bit rate a channel."""
    each = h.kbps // (1 if h.mono else 2)
    if h.version != 3:
        name = "low"
    elif each < 56:
        name = "d" if h.rate == 32000 else "c"
    else:
        name = "a" if h.rate == 48000 or each <= 80 else "b"
    return [bits for n, bits in _ALLOCATION[name] for _ in range(n)]


def _covered(data: bytes, h: Header) -> int:
    """How many bits after the checksum it covers: allocation (and scale factor choice) or side information."""
    channels = 1 if h.mono else 2
    if h.layer == 3:
        return 8 * h.side
    if h.layer == 1:
        return 4 * (h.bound * channels + 32 - h.bound) if channels == 2 else 128
    bits, at, used = int.from_bytes(data[:80].ljust(80, b"\0"), "big"), 0, 0
    for band, width in enumerate(_allocation(h)):
        for _ in range(channels if band < h.bound else 1):
            if bits >> (640 - at - width) & (1 << width) - 1:
                used += 1 if band < h.bound else channels
            at += width
    return at + 2 * used


HEAD = bytes((0xFF, 0xF2, 0xD8, 0x00))  # MPEG 2 Layer III, with checksum, 144 kbit/s, 16 kHz, stereo: 648 bytes


def _side(part: int) -> bytes:
    """Side information of two channels whose main data have ``part`` bits each."""
    bits = "0" * 10 + (f"{part:012b}" + "0" * 51) * 2
    return int(bits, 2).to_bytes(17, "big")


def _frame_start(part: int) -> bytes:
    side = _side(part)
    return HEAD + crc16(HEAD[2:] + side).to_bytes(2, "big") + side


def payload_of(text: str | None) -> tuple[bytes, int]:
    """(UTF-8 with bytes 255 up to a positive multiple of 576, length without them)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (-len(raw) % UNIT or (UNIT if not raw else 0)), len(raw)


def write(payload: bytes) -> bytes:
    """A tagged Layer III stream: ID3v2, an Info frame with frame count, bytes and seek table, one frame per 576 bytes."""
    n, start = len(payload) // UNIT, _frame_start(UNIT * 4)
    size = header(HEAD).size
    frames = np.zeros((n, size), np.uint8)
    frames[:, : len(start)] = np.frombuffer(start, np.uint8)
    frames[:, len(start) : len(start) + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    toc = bytes(min(255, k * 256 // 100) for k in range(100))
    info = _frame_start(0) + b"Info" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + ((n + 1) * size).to_bytes(8, "big")[-4:] + toc
    text = b"\x03payload\x00" + str(len(payload)).encode()
    frame = b"TXXX" + _syncsafe(len(text)) + b"\x00\x00" + text
    return b"ID3\x04\x00\x00" + _syncsafe(len(frame)) + frame + info + bytes(size - len(info)) + frames.tobytes()


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


@dataclass
class Stream:
    """What a stream holds. ``offsets``: the byte at which each audio frame begins; ``samples``: of one channel."""

    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    channels: int = 0
    kind: str = ""
    kbps: int = 0
    crc_good: int = 0
    crc_bad: int = 0
    skipped: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, object] | None = None
    payload: bytes = b""

    @property
    def played(self) -> int:
        """Samples without those that the encoder added, if its table says how many: the exact duration times the rate."""
        added = (self.table or {}).get("delay", 0) + (self.table or {}).get("padding", 0)
        return self.samples - added if added < self.samples else self.samples

    def seek(self, sample: int) -> int:
        """The offset of the frame that holds a sample."""
        per = self.samples // len(self.offsets)
        return self.offsets[min(max(sample, 0) // per, len(self.offsets) - 1)]


def _size(raw: bytes, seven: bool) -> int:
    return sum((b & 127 if seven else b) << (7 if seven else 8) * (len(raw) - 1 - k) for k, b in enumerate(raw))


def _id3v2(data: bytes, out: Stream) -> int:
    """The byte after an ID3v2 tag (2.2, 2.3 or 2.4) in front; text frames go into the tags."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    version, flags = data[3], data[5]
    stop = min(10 + _size(data[6:10], True), len(data))
    body = data[10:stop]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")  # unsynchronisation of the whole tag
    k = 0
    if flags & 0x40 and version >= 3:
        k = _size(body[:4], True) if version >= 4 else 4 + _size(body[:4], False)  # extended header
    head, wide = (6, 3) if version == 2 else (10, 4)
    while k + head <= len(body) and body[k]:
        n, own = _size(body[k + wide : k + 2 * wide], version >= 4), body[k + 9] if head == 10 else 0
        name, text = body[k : k + wide].decode("latin-1"), body[k + head : k + head + n]
        k += head + n
        if version >= 4 and own & 1:
            text = text[4:]  # the length before unsynchronisation
        if version >= 4 and (own & 2 or flags & 0x80):
            text = text.replace(b"\xff\x00", b"\xff")
        if name[0] == "T" and text:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(text[0], "latin-1")
            out.tags[name] = text[1:].decode(code, "replace").strip("\x00")
    return min(stop + (10 if version >= 4 and flags & 0x10 else 0), len(data))


def _id3v1(data: bytes, at: int, out: Stream) -> bool:
    """Whether the last 128 bytes, which begin at ``at``, are an ID3v1 tag."""
    if at != len(data) - 128 or data[at : at + 3] != b"TAG":
        return False
    out.tags["title"] = data[at + 3 : at + 33].rstrip(b"\x00 ").decode("latin-1")
    return True


def _table(data: bytes, at: int, h: Header) -> dict[str, object] | None:
    """A Xing, Info or VBRI table in the frame at ``at``."""
    k = at + 4 + 2 * h.protected + h.side
    if data[k : k + 4] in (b"Xing", b"Info"):
        out: dict[str, object] = {"kind": data[k : k + 4].decode()}
        flags, k = int.from_bytes(data[k + 4 : k + 8], "big"), k + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], k = int.from_bytes(data[k : k + 4], "big"), k + 4
        if flags & 4:
            out["toc"], k = list(data[k : k + 100]), k + 100
        k += 4 if flags & 8 else 0
        if data[k : k + 4] in (b"LAME", b"Lavc", b"Lavf"):  # samples that the encoder put in front and at the end
            both = int.from_bytes(data[k + 21 : k + 24], "big")
            out["delay"], out["padding"] = both >> 12, both & 0xFFF
        return out
    k = at + 36
    if data[k : k + 4] == b"VBRI":
        return {"kind": "VBRI", "bytes": int.from_bytes(data[k + 10 : k + 14], "big"), "frames": int.from_bytes(data[k + 14 : k + 18], "big")}
    return None


def read(data: bytes | None) -> Stream:
    """Parse a stream: tags, the variable-bitrate table, then every frame.

    A header counts if the next frame (or the end) follows where it says; else the reader moves on byte by byte to the
    next sync word, so damage costs the frames it touches. Checksums cover the last two header bytes and the side
    information (Layers I and II: the allocation, and in II the choice of scale factors). An ID3v1 tag is one only where
    frames end before it: the last frame's bytes may look like one. Frames with a bad checksum keep their place and time but add no payload. A last frame that is cut
    short is skipped. Durations are exact: frames times samples over the rate.
    """
    out = Stream()
    data = data or b""
    at, end = _id3v2(data, out), len(data)
    parts, locked, known = [], False, None
    while at + 4 <= end:
        if _id3v1(data, at, out):
            end = at
            break
        h = header(data[at : at + 4])
        fits = h is not None and h.size > 4 and at + h.size <= end and (known is None or (h.rate, h.layer, h.version) == known)
        if fits and not locked and at + h.size + 4 <= end:
            after = header(data[at + h.size : at + h.size + 4])
            fits = after is not None and (after.rate, after.layer, after.version) == (h.rate, h.layer, h.version)
        if not fits:
            step = data.find(b"\xff", at + 1, end)
            step = step if step >= 0 else end
            if at < end - 128 <= step and _id3v1(data, end - 128, out):
                end = step = end - 128
            out.skipped += step - at
            at, locked = step, False
            continue
        if known is None:
            known = (h.rate, h.layer, h.version)
            out.rate, out.kind, out.kbps, out.channels = h.rate, f"mpeg{ {3: '1', 2: '2', 0: '2.5'}[h.version]}-layer{h.layer}", h.kbps, 1 if h.mono else 2
            if h.layer == 3 and (table := _table(data, at, h)):
                out.table, at, locked = table, at + h.size, True
                continue
        locked = True
        good = True
        if h.protected:
            after = data[at + 6 : at + h.size]
            bits = _covered(after, h)
            good = crc16_bits(data[at + 2 : at + 4] + after[: -(-bits // 8)], 16 + bits) == int.from_bytes(data[at + 4 : at + 6], "big")
            out.crc_good += good
            out.crc_bad += not good
        out.offsets.append(at)
        out.sizes.append(h.size)
        out.samples += h.samples
        if good and h.layer == 3 and h.version != 3:
            k = at + 4 + 2 * h.protected
            side = int.from_bytes(data[k : k + h.side], "big")
            width, first = 8 * h.side, 9 if h.mono else 10
            bits = sum(side >> (width - first - 63 * c - 12) & 0xFFF for c in range(1 if h.mono else 2))
            parts.append(data[k + h.side : k + h.side + bits // 8])
        at += h.size
    out.skipped += max(0, end - at)
    out.payload = b"".join(parts)
    return out


def feature(s: Stream) -> str:
    """One line about a stream: form, exact duration, checks, a digest of the seek offsets, level of the payload."""
    level = np.frombuffer(s.payload, np.uint8).astype(np.int64)
    mean = f"{level.sum() / len(level):.4f},{(level * level).sum() / len(level):.4f}" if len(level) else "0,0"
    seek = zlib.crc32(np.array(s.offsets, "<i8").tobytes())
    kind = s.table["kind"] if s.table else "none"
    return (
        f"{s.kind};hz={s.rate};ch={s.channels};kbps={s.kbps};frames={len(s.offsets)};samples={s.samples};table={kind}"
        f";crc={s.crc_good}/{s.crc_good + s.crc_bad};skipped={s.skipped};seek={seek:08x};mean={mean}"
    )


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 2 << 20):
        made = [payload_of(cell.as_py()) for cell in batch.column(batch.schema.get_field_index("text"))]
        yield pa.record_batch([batch.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([write(p) for p, _ in made], pa.binary())], ["id", "n_bytes", "media"])


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text (null: empty) as an MPEG stream. Repeated rows are written each by itself."""
    bound_batches(docs)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_written, "id long, n_bytes long, media binary")


PROBE = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, samples long, rate int, duration double, frame_offsets array<long>"


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.int64()))
    names = [f.split()[0] for f in PROBE.split(", ")]
    for batch in slices(batches, "media", 2 << 20):
        ids, sizes = rows_of(batch, "id", "n_bytes")
        rows: list[list] = [[] for _ in names]
        for doc, n, cell in zip(ids, sizes, batch.column(batch.schema.get_field_index("media")), strict=True):
            raw = cell.as_py() or b""
            s = read(raw)
            values = (
                doc, n, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(s),
                s.played, s.rate, s.played / s.rate if s.rate else 0.0, s.offsets,
            )
            for column, value in zip(rows, values, strict=True):
                column.append(value)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names)


def probe(media: DataFrame) -> DataFrame:
    """Read a media column back: digests of payload and stored form, exact duration (samples, rate and seconds), and the
    byte offset of each frame, to seek by.

    Null and empty media have no frames and an empty payload; damaged media give what could be read.
    """
    return media.select("id", "n_bytes", "media").mapInArrow(_probed, PROBE)
