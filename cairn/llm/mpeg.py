"""MPEG audio columns: frame headers with resynchronisation, tags, variable-bitrate tables, checksums, exact durations
and seek offsets; and a lossless carrier of bytes in frames.

Parsing follows the chain of frames: a header gives its frame's length, and so the next header's place. Where no valid
header stands, the parser resynchronises: it looks for the next two headers in a row that agree in version, layer and
sampling rate (or one that ends the stream). ID3v2, ID3v1 and APEv2 tags are skipped and counted; a first frame with a
Xing, Info or VBRI table is read, not played. Durations are whole sample counts over the sampling rate.

The carrier stores each 576 bytes, one for each sample of a frame, behind the side information of an MPEG-2 Layer III
frame (mono, 144 kbit/s at 16 kHz, 648 bytes, with checksum): a player hears silence, the bytes come back unchanged.

Defined cases: null media has null results; empty media and media without a frame have zero frames and a duration of
0; a frame that the stream's end cuts is counted as truncated, not played; free-format frames count as no frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import map_arrow, slices, texts_of

# kbit/s by bitrate index, for MPEG-1 layers I, II, III and MPEG-2/2.5 layer I and layers II and III.
RATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
# Hz by version bits and sampling-rate index.
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

_CRC = []
for _i in range(256):
    _c = _i << 8
    for _ in range(8):
        _c = (_c << 1) ^ 0x8005 if _c & 0x8000 else _c << 1
    _CRC.append(_c & 0xFFFF)


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    for b in data:
        crc = ((crc << 8) & 0xFFFF) ^ _CRC[(crc >> 8) ^ b]
    return crc


@dataclass(frozen=True)
class Header:
    version: int  # 1, 2; 25 is 2.5
    layer: int
    protected: bool
    kbps: int
    hertz: int
    size: int
    samples: int
    side: int  # bytes of side information (Layer III)
    channels: int
    bound: int = 32  # subbands from here on share their allocation (joint stereo of Layers I and II)


_HEADERS: dict[int, Header | None] = {}


def header(word: int) -> Header | None:
    """What a frame header of 32 bits says, or None where it is none."""
    try:
        return _HEADERS[word]
    except KeyError:
        pass
    out = None
    bits, layer = word >> 19 & 3, 4 - (word >> 17 & 3)
    rate, hz = word >> 12 & 15, word >> 10 & 3
    if word >> 21 == 0x7FF and bits != 1 and layer != 4 and 0 < rate < 15 and hz < 3:
        first = 1 if bits == 3 else 2
        kbps, hertz, pad = RATES[first, layer][rate], HERTZ[bits][hz], word >> 9 & 1
        samples = 384 if layer == 1 else 1152 if layer == 2 or first == 1 else 576
        size = (12_000 * kbps // hertz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hertz + pad
        channels = 1 if word >> 6 & 3 == 3 else 2
        side = (17 if channels == 1 else 32) if first == 1 else (9 if channels == 1 else 17)
        bound = 4 * ((word >> 4 & 3) + 1) if word >> 6 & 3 == 1 else 32
        out = Header({3: 1, 2: 2, 0: 25}[bits], layer, not word >> 16 & 1, kbps, hertz, size, samples, side if layer == 3 else 0, channels, bound)
    if len(_HEADERS) < 4096:
        _HEADERS[word] = out
    return out


def _allocation_bits(h: Header) -> list[int]:
    """Bits of the allocation of each subband in Layer II."""
    # Subbands and widths by the standard's tables.
    if h.version != 1:
        return [4] * 4 + [3] * 7 + [2] * 19
    each = h.kbps // h.channels
    if each <= 48:
        return [4] * 2 + [3] * (10 if h.hertz == 32_000 else 6)
    return [4] * 11 + [3] * 12 + [2] * (4 if h.hertz == 48_000 or each <= 80 else 7)


def checked_bits(data: bytes, at: int, h: Header) -> int:
    """How many bits behind the checksum of the frame here it covers, beside the header's second half."""
    if h.layer == 3:
        return 8 * h.side
    if h.layer == 1:
        bound = h.bound if h.channels == 2 else 32
        return 4 * (bound * h.channels + 32 - bound)
    body = data[at + 6 : at + 70]
    value, left = int.from_bytes(body), 8 * len(body)
    used = scales = 0
    for sb, width in enumerate(_allocation_bits(h)):
        for _ in range(1 if sb >= h.bound else h.channels):
            used += width
            if used <= left and value >> (left - used) & ((1 << width) - 1):
                scales += h.channels if sb >= h.bound else 1
    return used + 2 * scales


def crc16_bits(data: bytes, bits: int) -> int:
    """The checksum of two bytes and so many bits behind them."""
    crc = crc16(data[: 2 + bits // 8])
    for i in range(bits // 8 * 8, bits):
        crc = (crc << 1 ^ (0x8005 if (crc >> 15 ^ data[2 + i // 8] >> (7 - i % 8)) & 1 else 0)) & 0xFFFF
    return crc


@dataclass
class Stream:
    tags: list[str] = field(default_factory=list)
    vbr: str = ""  # Xing, Info, VBRI
    vbr_frames: int = 0
    vbr_bytes: int = 0
    toc: list[int] = field(default_factory=list)
    frames: int = 0
    samples: int = 0
    seconds: float = 0.0
    hertz: int = 0
    version: int = 0
    layer: int = 0
    channels: int = 0
    kbps_sum: int = 0
    checked: int = 0
    bad_crc: int = 0
    resyncs: int = 0
    skipped: int = 0
    truncated: int = 0
    offsets: list[int] = field(default_factory=list)  # of each frame that plays


def _tag(data: bytes, at: int) -> tuple[str, int] | None:
    """Kind and length of a tag that starts here."""
    if data[at : at + 3] == b"ID3" and at + 10 <= len(data) and max(data[at + 6 : at + 10]) < 128:
        a, b, c, d = data[at + 6 : at + 10]
        return f"ID3v2.{data[at + 3]}", 10 + (a << 21 | b << 14 | c << 7 | d) + (10 if data[at + 5] & 16 else 0)
    if data[at : at + 3] == b"TAG" and len(data) - at == 128:
        return "ID3v1", 128
    if data[at : at + 8] == b"APETAGEX" and at + 32 <= len(data):
        size, flags = struct.unpack_from("<I4xI", data, at + 12)
        return "APEv2", size + (32 if flags >> 29 & 1 else 0)
    return None


def _table(data: bytes, at: int, h: Header, out: Stream) -> bool:
    """Whether the frame here holds a variable-bitrate table; what it says goes to out."""
    place = at + 4 + 2 * h.protected + h.side
    kind = data[place : place + 4]
    if kind in (b"Xing", b"Info"):
        flags, place = int.from_bytes(data[place + 4 : place + 8]), place + 8
        if flags & 1:
            out.vbr_frames, place = int.from_bytes(data[place : place + 4]), place + 4
        if flags & 2:
            out.vbr_bytes, place = int.from_bytes(data[place : place + 4]), place + 4
        if flags & 4:
            out.toc = list(data[place : place + 100])
    elif data[at + 36 : at + 40] == b"VBRI":
        kind = b"VBRI"
        out.vbr_bytes, out.vbr_frames, entries, scale, width = struct.unpack_from(">IIHHH", data[at + 46 : at + 60].ljust(14, b"\0"))
        base = at + 62
        out.toc = [int.from_bytes(data[base + i * width : base + (i + 1) * width]) * scale for i in range(entries)] if 0 < width <= 4 else []
    else:
        return False
    out.vbr = kind.decode()
    return True


def parse(data: bytes) -> Stream:
    """All of a stream."""
    out, at, n = Stream(), 0, len(data)
    word = lambda i: int.from_bytes(data[i : i + 4]) if i + 4 <= n else 0
    lost = False
    while at < n:
        h = header(word(at))
        if h and (lost or not out.frames):  # a lone match in other data is no frame: the next header must agree
            follow = header(word(at + h.size))
            if not (follow and (follow.version, follow.layer, follow.hertz) == (h.version, h.layer, h.hertz)) and at + h.size < n and not _tag(data, at + h.size):
                h = None
        if not h:
            if found := _tag(data, at):
                out.tags.append(found[0])
                at += found[1]
                continue
            if not lost:
                out.resyncs += 1
                lost = True
            step = data.find(b"\xff", at + 1)
            tag = min((x for x in (data.find(b"ID3", at + 1), data.find(b"APETAGEX", at + 1), n - 128 if data[n - 128 : n - 125] == b"TAG" and n - 128 > at else -1) if x > 0), default=n)
            to = min(step if step > 0 else n, tag)
            out.skipped += to - at
            at = to
            continue
        lost = False
        if at + h.size > n:
            out.truncated += 1
            break
        if h.protected:
            out.checked += 1
            bits = checked_bits(data, at, h)
            out.bad_crc += crc16_bits(data[at + 2 : at + 4] + data[at + 6 : at + 6 + -(-bits // 8)], bits) != int.from_bytes(data[at + 4 : at + 6])
        if not (not out.frames and not out.vbr and h.layer == 3 and _table(data, at, h, out)):
            if not out.frames:
                out.hertz, out.version, out.layer, out.channels = h.hertz, h.version, h.layer, h.channels
            out.frames += 1
            out.samples += h.samples
            out.seconds += h.samples / h.hertz if h.hertz != out.hertz else 0
            out.kbps_sum += h.kbps
            out.offsets.append(at)
        at += h.size
    if out.hertz:
        other = out.seconds
        out.seconds = out.samples / out.hertz if not other else other + (out.samples - round(other * out.hertz)) / out.hertz
    return out


def seek_points(offsets: list[int], points: int = 100) -> list[int]:
    """Byte offset of the frame at each of so many equal steps of the duration."""
    return [offsets[i * len(offsets) // points] for i in range(points)] if offsets else []


UNIT = 576
_WORD = 0x7FF << 21 | 2 << 19 | 1 << 17 | 13 << 12 | 2 << 10 | 3 << 6  # MPEG-2, III, checksum, 144 kbit/s, 16 kHz, mono
_FRAME = header(_WORD)
_LEAD = struct.pack(">I", _WORD) + struct.pack(">H", crc16(struct.pack(">I", _WORD)[2:] + bytes(9))) + bytes(9)
_TAIL = bytes(648 - len(_LEAD) - UNIT)


def payload_of(text: str) -> tuple[int, bytes]:
    """Length of the text in UTF-8, and these bytes with 255 up to a positive multiple of UNIT."""
    data = text.encode()
    return len(data), data + b"\xff" * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def carry(payload: bytes) -> bytes:
    """A stream of an ID3v2 tag, a frame with an Info table, and a frame for each UNIT bytes."""
    count = len(payload) // UNIT
    title = b"TSSE" + struct.pack(">IH", 6, 0) + b"\0cairn"
    tag = b"ID3\x03\0\0" + bytes((0, 0, 0, len(title))) + title
    total = 648 * (count + 1)
    toc = bytes((256 * 648 * (1 + i * count // 100)) // total for i in range(100))
    info = (_LEAD + b"Info" + struct.pack(">III", 7, count, total) + toc).ljust(648, b"\0")
    view = memoryview(payload)
    return tag + info + b"".join([x for i in range(0, len(payload), UNIT) for x in (_LEAD, view[i : i + UNIT], _TAIL)])


def uncarry(data: bytes, stream: Stream) -> bytes:
    """The payload of a carrier that was parsed."""
    lead, view = len(_LEAD), memoryview(data)
    return b"".join([view[o + lead : o + lead + UNIT] for o in stream.offsets])


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a stream."""

    def make():
        def each(batch: pa.RecordBatch):
            for part, texts in slices(batch):
                both = [payload_of(t) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in both], pa.int64()), pa.array([carry(p) for _, p in both], pa.binary())], names=["doc_id", "n_bytes", "media"])

        return each

    return map_arrow(texts_of(df, id_col, text_col), make, "doc_id long, n_bytes long, media binary")


ANALYSIS = "tags array<string>, vbr string, vbr_frames long, vbr_bytes long, frames long, samples long, hertz int, seconds double, kbps double, crc_checked long, crc_bad long, resyncs long, skipped_bytes long, truncated long, frame_offsets array<long>, seek_offsets array<long>"


def _analysed(s: Stream | None) -> list:
    if s is None:
        return [None] * 16
    return [s.tags, s.vbr, s.vbr_frames, s.vbr_bytes, s.frames, s.samples, s.hertz, s.seconds, s.kbps_sum / s.frames if s.frames else 0.0, s.checked, s.bad_crc, s.resyncs, s.skipped, s.truncated, s.offsets, seek_points(s.offsets)]


def _kinds() -> list[pa.DataType]:
    return [pa.list_(pa.string()), pa.string(), *[pa.int64()] * 4, pa.int32(), pa.float64(), pa.float64(), *[pa.int64()] * 5, *[pa.list_(pa.int64())] * 2]


def analyse(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each: the id and ANALYSIS of its media."""

    def make():
        def each(batch: pa.RecordBatch):
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_py()
                values = _analysed(None if data is None else parse(data))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *[pa.array([v], k) for v, k in zip(values, _kinds())]], names=["doc_id", *[x.split()[0] for x in ANALYSIS.split(", ")]])

        return each

    return map_arrow(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")), make, f"doc_id long, {ANALYSIS}")


def describe(s: Stream) -> str:
    """Features of a stream in one line."""
    seek = zlib.crc32(struct.pack(f"<{len(x)}q", *x)) if (x := seek_points(s.offsets)) else 0
    return f"mpeg{s.version}-l{s.layer} ch={s.channels} hz={s.hertz} frames={s.frames} samples={s.samples} ms={s.samples * 1000 / s.hertz if s.hertz else 0:.3f} vbr={s.vbr} table={s.vbr_frames} crc={s.checked - s.bad_crc}/{s.checked} resync={s.resyncs} seek={seek:08x}"


def read_back(df: DataFrame) -> DataFrame:
    """Digests of what store_texts stored: the payload that the frames hold, and the features that parsing finds."""

    def make():
        def each(batch: pa.RecordBatch):
            found = []
            for i in range(batch.num_rows):
                data = batch.column(2)[i].as_py()
                stream = parse(data)
                payload = uncarry(data, stream)
                found.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), describe(stream), stream.samples / stream.hertz, stream.frames, stream.bad_crc, stream.offsets))
            columns = list(zip(*found))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["doc_id", "n_bytes", *READ_BACK])

        return each

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, frames long, crc_bad long, frame_offsets array<long>"
    return map_arrow(df.select("doc_id", "n_bytes", "media"), make, schema)


READ_BACK = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seconds", "frames", "crc_bad", "frame_offsets")
