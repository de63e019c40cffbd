"""Media columns: baseline JPEG files written, parsed and Huffman-decoded in numpy.

The decoder parses the markers of a baseline file (SOF0, DHT, DQT, DRI, SOS,
COM), decodes the scan and rebuilds the luminance thumbnail from the DC
coefficients alone.  Restart intervals are independent, so all of them, of all
files of a batch, advance together one symbol at a time.

A payload is stored losslessly in the format's own unit, the quantised
coefficient: byte b is coefficient b - 255, 64 bytes make a block, three blocks
(luminance, two chrominance) one MCU of 192 bytes, and each MCU is a restart
interval.  Text bytes below 128 then all have category 8, whose code has one
bit.  The payload's length stands in a comment; an image of several columns is
filled up with blanks.

Defined results: a null text is stored like an empty one, as 192 blanks; equal
texts give equal files and features; repeated rows and null doc_ids each give
their own row; an empty table gives an empty result; other columns are ignored.
Files are encoded and decoded a bounded number of MCUs at a time.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remote, table

MCU = 192
MOST_ROWS = 8191  # MCU rows; a JPEG has at most 65,535 lines
AT_ONCE = 4096  # MCUs
DC_STEP = 4  # the DC quantiser; thumbnails are coefficient * step / 8 + 128
SCHEMA = "doc_id long, n_bytes long, payload binary, media binary, width int, height int, thumbnail_hash long"

# Symbols in order of code length: category 8 has one bit, everything else five (DC) or nine (AC).
DC_CODES = [[8], [], [], [], [c for c in range(12) if c != 8]]
AC_CODES = [[8], *[[] for _ in range(7)], [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11) if (run, size) != (0, 8))]]


def canonical(by_length: list[list[int]]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of a Huffman table given as symbols by code length."""
    out, code = {}, 0
    for length, symbols in enumerate(by_length, 1):
        for s in symbols:
            out[s] = (code, length)
            code += 1
        code <<= 1
    return out


def peek_table(by_length: list[list[int]]) -> np.ndarray:
    """For all 16-bit prefixes: symbol << 8 | code length; length 0 marks an invalid code."""
    out = np.zeros(1 << 16, np.int64)
    for s, (code, n) in canonical(by_length).items():
        out[code << (16 - n) : (code + 1) << (16 - n)] = s << 8 | n
    return out


def _arrays(by_length) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for s, (c, n) in canonical(by_length).items():
        code[s], length[s] = c, n
    return code, length


_DC, _AC = _arrays(DC_CODES), _arrays(AC_CODES)
_CATEGORY = np.array([abs(v).bit_length() for v in range(-2047, 2048)], np.int64)


def encode_mcus(payload: np.ndarray, restart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of MCUs (n, 192), each followed by marker RST(restart mod 8), and where each ends."""
    value = payload.reshape(-1, 64).astype(np.int64) - 255
    size = _CATEGORY[value + 2047]
    raw = np.where(value < 0, value + (1 << size) - 1, value).astype(np.uint64)
    ac = value[:, 1:] != 0
    place = np.arange(1, 64) * ac
    before = np.maximum.accumulate(np.concatenate((np.zeros((len(value), 1), np.int64), place), axis=1), axis=1)
    run = np.where(ac, np.arange(1, 64) - before[:, :-1] - 1, 0)
    symbol = (run & 15) << 4 | size[:, 1:]
    bits = np.empty(value.shape, np.uint64)
    length = np.empty(value.shape, np.int64)
    bits[:, 0] = _DC[0][size[:, 0]] << size[:, 0].astype(np.uint64) | raw[:, 0]
    length[:, 0] = _DC[1][size[:, 0]] + size[:, 0]
    tail = size[:, 1:].astype(np.uint64)
    zrl, zrl_bits = int(_AC[0][0xF0]), int(_AC[1][0xF0])
    long_run = (run >> 4).astype(np.uint64)
    prefix = np.array([sum(zrl << (i * zrl_bits) for i in range(n)) for n in range(4)], np.uint64)[long_run]
    own = _AC[1][symbol] + size[:, 1:]
    bits[:, 1:] = np.where(ac, prefix << own.astype(np.uint64) | _AC[0][symbol] << tail | raw[:, 1:], 0)
    length[:, 1:] = np.where(ac, own + (run >> 4) * zrl_bits, 0)
    open_end = np.flatnonzero(before[:, -1] < 63)  # end-of-block goes with the last coefficient's bits
    last = before[open_end, -1]
    bits[open_end, last] = bits[open_end, last] << np.uint64(_AC[1][0]) | _AC[0][0]
    length[open_end, last] += _AC[1][0]
    bits, length = bits.reshape(-1, MCU), length.reshape(-1, MCU)
    n_bits = length.sum(axis=1)
    n_bytes = (n_bits + 7) // 8
    pad = n_bytes * 8 - n_bits  # filled with ones
    bits[:, -1] = bits[:, -1] << pad.astype(np.uint64) | (np.uint64(1) << pad.astype(np.uint64)) - np.uint64(1)
    length[:, -1] += pad
    ends = np.cumsum(length.ravel())
    offset = ends - length.ravel()
    kept = length.ravel() > 0
    offset, length, bits = offset[kept], length.ravel()[kept], bits.ravel()[kept]
    total = int(ends[-1]) // 8
    packed = np.zeros(total + 9)
    if int(length.max()) > 57:  # a window holds 57 bits at any bit offset; split what is longer
        far = length > 32
        offset = np.concatenate((offset, offset[far] + length[far] - 32))
        bits = np.concatenate((np.where(far, bits >> np.uint64(32), bits), bits[far] & np.uint64(0xFFFFFFFF)))
        length = np.concatenate((np.where(far, length - 32, length), np.full(int(far.sum()), 32)))
    window = bits << (64 - length - (offset & 7)).astype(np.uint64)
    first = offset >> 3
    for j in range(8):
        part = (window >> np.uint64(56 - 8 * j)) & np.uint64(255)
        some = np.flatnonzero(part)
        if len(some):
            packed += np.bincount(first[some] + j, weights=part[some], minlength=total + 9)
    data = packed[:total].astype(np.uint8)
    stuffed = np.cumsum(data == 255)
    mcu = np.repeat(np.arange(len(n_bytes)), n_bytes)
    at = np.arange(total) + np.concatenate(([0], stuffed[:-1])) + 2 * mcu
    out = np.zeros(total + int(stuffed[-1]) + 2 * len(n_bytes), np.uint8)
    out[at] = data
    stops = np.cumsum(n_bytes) - 1
    marker = at[stops] + 1 + (data[stops] == 255)
    out[marker], out[marker + 1] = 255, 0xD0 + restart % 8
    return out, marker + 2


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _dht(kind: int, by_length) -> bytes:
    full = by_length + [[] for _ in range(16 - len(by_length))]
    return _segment(0xC4, bytes([kind << 4, *(len(x) for x in full), *(s for x in full for s in x)]))


def grid(n_mcus: int) -> tuple[int, int]:
    """(MCU columns, MCU rows) of an image for that many MCUs."""
    columns = -(-n_mcus // MOST_ROWS)
    return columns, -(-n_mcus // columns)


def header(n_bytes: int, n_mcus: int) -> bytes:
    columns, rows = grid(n_mcus)
    quantisers = bytes([0, DC_STEP, *[1] * 63])
    frame = struct.pack(">BHHB", 8, rows * 8, columns * 8, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"".join((b"\xff\xd8", _segment(0xFE, b"payload %d" % n_bytes), _segment(0xDB, quantisers), _segment(0xC0, frame), _dht(0, DC_CODES), _dht(1, AC_CODES), _segment(0xDD, struct.pack(">H", 1)), _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))))


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % MCU or (0 if raw else MCU))


def write_files(payloads: list[bytes]) -> list[bytes]:
    """A JPEG file for each payload, whose length is a positive multiple of 192."""
    counts = [len(p) // MCU for p in payloads]
    whole = [c * r for c, r in map(grid, counts)]
    mcus = np.frombuffer(b"".join(p + b" " * ((w - n) * MCU) for p, n, w in zip(payloads, counts, whole, strict=True)), np.uint8).reshape(-1, MCU)
    restart = np.concatenate([np.arange(w) for w in whole])
    parts, ends, size = [], [], 0
    for at in range(0, len(mcus), AT_ONCE):
        data, stops = encode_mcus(mcus[at : at + AT_ONCE], restart[at : at + AT_ONCE])
        parts.append(data.tobytes())
        ends.append(stops + size)
        size += len(data)
    scan, cuts = b"".join(parts), np.concatenate(([0], *ends))
    out, mcu = [], 0
    for p, n, w in zip(payloads, counts, whole, strict=True):
        out.append(header(len(p), n) + scan[cuts[mcu] : cuts[mcu + w] - 2] + b"\xff\xd9")
        mcu += w
    return out


@dataclass
class Jpeg:
    """The parts of a parsed baseline file."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # (id, horizontal, vertical, quantiser)
    quantisers: dict[int, list[int]] = field(default_factory=dict)
    huffman: dict[int, tuple[tuple[int, ...], ...]] = field(default_factory=dict)  # class << 4 | number
    tables: dict[int, tuple[int, int]] = field(default_factory=dict)  # component -> (DC, AC) table numbers
    interval: int = 0
    comments: list[bytes] = field(default_factory=list)
    scan: bytes = b""

    @property
    def layout(self) -> tuple:
        """What files must share to be decoded together."""
        return tuple((h, v, self.huffman[t[0]], self.huffman[16 | t[1]]) for i, h, v, _ in self.components for t in [self.tables[i]])

    @property
    def mcus(self) -> tuple[int, int]:
        h, v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse(data: bytes) -> Jpeg:
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    out, at = Jpeg(), 2
    while at + 4 <= len(data):
        if data[at] != 255:
            raise ValueError(f"no marker at {at}")
        marker = data[at + 1]
        if marker == 255:
            at += 1
            continue
        n = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if at > len(data):
            raise ValueError("truncated file")
        if marker == 0xC0:
            _, out.height, out.width, count = struct.unpack_from(">BHHB", body)
            out.components = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * count, 3)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline files are supported")
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                lengths, k = body[i + 1 : i + 17], i + 17
                rows = []
                for m in lengths:
                    rows.append(tuple(body[k : k + m]))
                    k += m
                out.huffman[body[i]], i = tuple(rows), k
        elif marker == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                out.quantisers[body[i] & 15] = list(struct.unpack_from(">64H" if wide else ">64B", body, i + 1))
                i += 129 if wide else 65
        elif marker == 0xDD:
            out.interval = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            out.comments.append(body)
        elif marker == 0xDA:
            out.tables = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            end = data.rfind(b"\xff\xd9")
            if end < at or not out.components:
                raise ValueError("truncated file")
            out.scan = data[at:end]
            return out
    raise ValueError("no scan")


def segments(scan: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The scan's bytes without stuffing and restart markers, and where each restart interval begins."""
    raw = np.frombuffer(scan, np.uint8)
    ff = np.flatnonzero(raw[:-1] == 255)
    follows = raw[ff + 1]
    restarts = ff[(follows >= 0xD0) & (follows <= 0xD7)]
    keep = np.ones(len(raw), bool)
    keep[ff[follows == 0] + 1] = False
    keep[restarts] = keep[restarts + 1] = False
    kept = np.cumsum(keep)
    return raw[keep], np.concatenate(([0], kept[restarts]))


_PEEK: dict[tuple, np.ndarray] = {}


def _peek(by_length: tuple) -> np.ndarray:
    if by_length not in _PEEK:
        _PEEK[by_length] = peek_table([list(x) for x in by_length])
    return _PEEK[by_length]


def decode_segments(data: np.ndarray, starts: np.ndarray, n_mcus: np.ndarray, layout: tuple) -> np.ndarray:
    """Coefficients (segment, MCU, block, 64) in zigzag order, DC differences summed up, of restart intervals of one layout."""
    blocks = [(i, _peek(dc), _peek(ac)) for i, (h, v, dc, ac) in enumerate(layout) for _ in range(h * v)]
    most = int(n_mcus.max())
    out = np.zeros((len(starts), most, len(blocks), 64), np.int16)
    room = np.concatenate((data, np.full(16, 255, np.uint8)))
    words = np.ndarray((len(room) - 8,), ">u8", room, strides=(1,))
    limit = (len(words) - 1) * 8
    at = starts.astype(np.int64) * 8
    predicted = np.zeros((len(layout), len(starts)), np.int64)

    def symbol(live, peek):
        where = np.minimum(at[live], limit)
        window = words[where >> 3].astype(np.uint64) << (where & 7).astype(np.uint64)
        got = peek[window >> np.uint64(48)]
        n = got & 255
        if not n.all():
            raise ValueError("invalid Huffman code")
        return got >> 8, n, window

    def value(size, n, window):
        raw = ((window << n.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        return np.where(raw < (1 << size) >> 1, raw - (1 << size) + 1, raw)

    for m in range(most):
        there = np.flatnonzero(n_mcus > m)
        for b, (component, dc, ac) in enumerate(blocks):
            size, n, window = symbol(there, dc)
            predicted[component, there] += value(size, n, window)
            out[there, m, b, 0] = predicted[component, there]
            at[there] += n + size
            live, k = there, np.ones(len(there), np.int64)
            while len(live):
                s, n, window = symbol(live, ac)
                size = s & 15
                k = k + (s >> 4)
                at[live] += n + size
                some = size > 0
                if (k[some] > 63).any():
                    raise ValueError("coefficient beyond the block")
                if some.all():
                    out[live, m, b, k] = value(size, n, window)
                else:
                    out[live[some], m, b, k[some]] = value(size, n, window)[some]
                k = np.where(s == 0, 64, k + 1)
                more = k < 64
                if not more.all():
                    live, k = live[more], k[more]
    return out


def read_files(files: list[bytes]) -> list[tuple[Jpeg, np.ndarray]]:
    """(parsed file, coefficients (MCU, block, 64)) of each file; files of one layout are decoded together."""
    parsed = [parse(f) for f in files]
    found: list = [None] * len(files)
    groups: dict[tuple, list[int]] = {}
    for i, p in enumerate(parsed):
        groups.setdefault(p.layout, []).append(i)
    for layout, members in groups.items():
        data, starts, counts, size = [], [], [], 0
        for i in members:
            raw, begin = segments(parsed[i].scan)
            total = parsed[i].mcus[0] * parsed[i].mcus[1]
            step = parsed[i].interval or total
            own = np.minimum(step, total - np.arange(len(begin)) * step)
            if own.sum() != total or (own <= 0).any():
                raise ValueError("restart intervals do not match the image")
            data.append(raw)
            starts.append(begin + size)
            counts.append(own)
            size += len(raw)
        where = np.concatenate(([0], np.cumsum([len(c) for c in counts])))
        data, starts, counts = np.concatenate(data), np.concatenate(starts), np.concatenate(counts)
        parts = []
        for a in range(0, len(starts), AT_ONCE):
            n = counts[a : a + AT_ONCE]
            got = decode_segments(data, starts[a : a + AT_ONCE], n, layout)
            parts.append(got[np.arange(got.shape[1]) < n[:, None]])
        flat = np.concatenate(parts)
        cuts = np.concatenate(([0], np.cumsum(counts)))[where]
        for i, a, b in zip(members, cuts[:-1], cuts[1:], strict=True):
            found[i] = (parsed[i], flat[a:b])
    return found


def thumbnail(image: Jpeg, coefficients: np.ndarray) -> np.ndarray:
    """Luminance of each 8 x 8 block from its DC coefficient, as bytes."""
    columns, rows = image.mcus
    _, h, v, q = image.components[0]
    dc = coefficients[:, : h * v, 0].astype(np.float64) * image.quantisers[q][0] / 8 + 128
    shape = dc.reshape(rows, columns, v, h).transpose(0, 2, 1, 3).reshape(rows * v, columns * h)
    return np.clip(np.floor(shape + 0.5), 0, 255).astype(np.uint8)


def thumbnail_hash(thumb: np.ndarray) -> int:
    """64 bits: whether each of 64 stretches of the thumbnail is brighter than the one before."""
    flat = thumb.ravel().astype(np.float64)
    edges = np.arange(66) * len(flat) // 65
    total = np.concatenate(([0], np.cumsum(flat)))
    width = np.maximum(1, np.diff(edges))
    upper = np.minimum(edges[:-1] + width, len(flat))
    mean = (total[upper] - total[upper - width]) / width
    return int(np.packbits(mean[1:] > mean[:-1]).view(">u8")[0])


def payload_of(image: Jpeg, coefficients: np.ndarray) -> bytes:
    """The payload that ``write_files`` stored."""
    n = next(int(c.split()[1]) for c in image.comments if c.startswith(b"payload "))
    return (coefficients.reshape(-1)[:n] + 255).astype(np.uint8).tobytes()


def media_batches(batches):
    for batch in batches:
        docs, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        at = 0
        while at < len(docs):
            some, size = [], 0  # a file at least, then as many as make about one round of MCUs
            while at < len(docs) and (not some or size < AT_ONCE * MCU // 2):
                some.append(padded(texts[at].as_py()))
                size += len(some[-1])
                at += 1
            files = write_files(some)
            rows = []
            for i, (file, (image, coefficients)) in enumerate(zip(files, read_files(files), strict=True), at - len(some)):
                payload, thumb = payload_of(image, coefficients), thumbnail(image, coefficients)
                n = len((texts[i].as_py() or "").encode())
                rows.append((docs[i], n, payload, file, image.width, image.height, int(np.uint64(thumbnail_hash(thumb)).view(np.int64))))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def media_files(docs: DataFrame) -> DataFrame:
    """For every text its file, the payload read back from it, dimensions and the thumbnail's hash."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(remote("lamina.llm.media:media_batches"), SCHEMA)


def media_digests(docs: DataFrame) -> DataFrame:
    """Digests of the file and of the payload read back from it, and dimensions with the thumbnail's hash, for every text."""
    feature = F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"), F.lit(":"), F.lpad(F.lower(F.hex("thumbnail_hash")), 16, "0"))
    payload, media = F.col("payload"), F.col("media")
    digests = [F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(F.substring(payload, -16, 16)).alias("tail_crc32"), F.octet_length(media).cast("long").alias("media_bytes"), F.sha2(media, 256).alias("media_sha256")]
    return media_files(docs).select("doc_id", "n_bytes", *digests, feature.alias("feature"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents stored as a baseline JPEG and read back."""
    return media_digests(table(spark, sf_dir, "documents"))
