"""Baseline JPEG in numpy: markers, Huffman decoding of scans, and thumbnails of the luminance DC values.

Decoding takes a batch of images. Every stretch of a scan between restart markers starts at a byte and is
independent, so all stretches of all images advance together, one Huffman symbol a step: the work is vectorised
over stretches. AC symbols are decoded to find the next block and dropped; the DC value of each luminance block
is its mean, and the means form a thumbnail of one pixel for every 8 x 8 block.

:func:`encode_payload` stores bytes without loss: one block for each byte, whose DC value is the byte (the
quantiser is 8, so that the block's mean is exactly the sample), with a restart marker after each row of blocks.
The thumbnail of such an image is the payload. A payload too large for one frame is a sequence of images.

Defined cases: a null text counts as empty (one padded image); equal texts give equal files; null ``doc_id``
stays null; repeated rows each give a row; other columns are not read; an empty table gives no rows.
Progressive, lossless or arithmetic frames and bad streams raise ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberloom.llm.bpe import blocks, sizes

UNIT = 576
#: Blocks in a row of an image made by encode_payload, and the rows of one frame at most (65535 pixels).
ROW = 24
FRAME_ROWS = 65535 // 8
BATCH_BYTES = 2_000_000
#: Code lengths of the DC categories 0 to 8 in files made here; categories as the standard defines them.
_DC_LENGTHS = {3: 2, 4: 2, 5: 3, 6: 3, 7: 4, 2: 4, 8: 5, 1: 5, 0: 5}


def _codes(counts: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) in canonical order."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out.append((s, code, length))
            code += 1
        code, at = code << 1, at + n
    return out


def _dc_spec() -> tuple[list[int], list[int]]:
    order = sorted(_DC_LENGTHS, key=lambda s: (_DC_LENGTHS[s], s))
    return [sum(n == length for n in _DC_LENGTHS.values()) for length in range(1, 17)], order


def lookup(counts: list[int], symbols: list[int]) -> np.ndarray:
    """For each 16-bit window, ``length << 8 | symbol``; 0 where no code fits."""
    table = np.zeros(1 << 16, np.int32)
    for symbol, code, length in _codes(counts, symbols):
        table[code << (16 - length) : (code + 1) << (16 - length)] = (length << 8) | symbol
    return table


# --- encoding -------------------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(width: int, height: int) -> bytes:
    counts, symbols = _dc_spec()
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xDB, bytes([0]) + bytes([8]) * 64),
            _segment(0xC0, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0)),
            _segment(0xC4, bytes([0x00, *counts, *symbols])),
            _segment(0xC4, bytes([0x10, 1, *[0] * 15, 0])),
            _segment(0xDD, struct.pack(">H", ROW)),
            _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        ]
    )


def _dc_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each difference + 255: the bits of its block (code, amplitude, end of block) and their number."""
    code = {s: (c, n) for s, c, n in _codes(*_dc_spec())}
    bits, lens = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        c, n = code[size]
        amplitude = d if d > 0 else d + (1 << size) - 1
        bits[d + 255] = (c << size | amplitude) << 1
        lens[d + 255] = n + size + 1
    return bits, lens


_BITS, _LENS = _dc_tables()


def encode_payload(payload: bytes) -> bytes:
    """One JPEG image or more, of which the luminance DC values are the bytes of the payload."""
    if len(payload) % UNIT:
        raise ValueError("the payload must be a multiple of 576 bytes")
    most = FRAME_ROWS * ROW // UNIT * UNIT
    return b"".join(_encode_frame(payload[at : at + most]) for at in range(0, len(payload), most))


def _encode_frame(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).astype(np.int64).reshape(-1, ROW) - 128
    diff = np.diff(rows, axis=1, prepend=0) + 255
    lens = _LENS[diff]
    ends = np.cumsum(lens, axis=1)
    size = (ends[:, -1] + 7) // 8  # bytes of each row's stretch
    base = np.concatenate([[0], np.cumsum(size)[:-1]]) * 8
    first = (base[:, None] + ends - lens).ravel()
    # a block has 14 bits at most, so it reaches over three bytes
    word = _BITS[diff].ravel().astype(np.uint64) << (32 - (first & 7) - lens.ravel()).astype(np.uint64)
    out = np.zeros(int(size.sum()) + 4, np.uint8)
    at = first >> 3
    for k in range(3):
        part = ((word >> np.uint64(24 - 8 * k)) & np.uint64(255)).astype(np.float64)
        out[: len(out)] |= np.bincount(at + k, part, minlength=len(out)).astype(np.uint8)  # no two blocks share a bit
    pad = (size * 8 - ends[:, -1]).astype(np.int64)
    last = np.cumsum(size) - 1
    out[last] |= ((1 << pad) - 1).astype(np.uint8)  # the standard pads with ones
    data = out[:-4]
    stuffed = np.flatnonzero(data == 255)
    marks = np.arange(len(rows) - 1) % 8 + 0xD0
    where = np.concatenate([stuffed + 1, np.repeat(last[:-1] + 1, 2)])
    what = np.concatenate([np.zeros(len(stuffed), np.int64), np.column_stack([np.full(len(marks), 255), marks]).ravel()])
    order = np.argsort(where, kind="stable")
    scan = np.insert(data, where[order], what[order].astype(np.uint8))
    return _header(ROW * 8, len(rows) * 8) + scan.tobytes() + b"\xff\xd9"


# --- decoding -------------------------------------------------------------------------------------------------


@dataclass
class Image:
    """What the markers of one image say, and where its scan's stretches are."""

    width: int = 0
    height: int = 0
    components: list = field(default_factory=list)  # (id, horizontal, vertical, quantiser, DC table, AC table)
    quantisers: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)
    interval: int = 0
    scan: bytes = b""
    end: int = 0
    thumbnail: np.ndarray | None = None


def parse(data: bytes, at: int = 0) -> Image:
    """The image that starts at ``at``; baseline, all components in one scan."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    image, at = Image(), at + 2
    while True:
        if data[at : at + 1] != b"\xff":
            raise ValueError(f"no marker at {at}")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            raise ValueError("no scan")
        length = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + length], at + 2 + length
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quantisers[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC0:
            depth, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise ValueError("baseline has 8-bit samples")
            image.components = [[body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i], 0, 0] for i in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline frame")
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                n = sum(counts)
                image.tables[body[0]] = (tuple(counts), tuple(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xDD:
            image.interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if body[0] != len(image.components):
                raise ValueError("the components are not in one scan")
            for i in range(body[0]):
                for c in image.components:
                    if c[0] == body[1 + 2 * i]:
                        c[4], c[5] = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
            break
    raw = np.frombuffer(data, np.uint8, offset=at)
    ff = np.flatnonzero(raw[:-1] == 255)
    after = raw[ff + 1]
    stop = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 255)]
    if not len(stop):
        raise ValueError("no end of image")
    image.scan, image.end = raw[: stop[0]], at + int(stop[0]) + 2
    return image


def _stretches(image: Image) -> tuple[np.ndarray, np.ndarray]:
    """The scan without stuffing and markers, and the byte at which each stretch starts."""
    raw = image.scan
    ff = np.flatnonzero(raw[:-1] == 255)
    after = raw[ff + 1]
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    gone = np.concatenate([ff[after == 0] + 1, marks, marks + 1])
    keep = np.ones(len(raw), bool)
    keep[gone] = False
    before = np.cumsum(keep)
    return raw[keep], np.concatenate([[0], before[marks]]).astype(np.int64)


def _layout(image: Image) -> tuple[list, int, int]:
    """Per block of a minimum coded unit (component number, its DC and AC table), and units across and down."""
    if len(image.components) == 1:
        return [(0, image.components[0][4], image.components[0][5])], -(-image.width // 8), -(-image.height // 8)
    h, v = max(c[1] for c in image.components), max(c[2] for c in image.components)
    plan = [(i, c[4], c[5]) for i, c in enumerate(image.components) for _ in range(c[1] * c[2])]
    return plan, -(-image.width // (8 * h)), -(-image.height // (8 * v))


def decode_thumbnails(images: list[Image]) -> None:
    """Set ``thumbnail`` (the luminance mean of each block) of all images, those of one layout together."""
    groups: dict = {}
    for image in images:
        plan, across, down = _layout(image)
        key = (tuple(plan), tuple(sorted(image.tables.items())))
        groups.setdefault(key, []).append((image, across, down))
    for (plan, tables), members in groups.items():
        _decode_group(list(plan), dict(tables), members)


def _decode_group(plan: list, tables: dict, members: list) -> None:
    data, starts, units, spans = [], [], [], []
    at = n = 0
    for image, across, down in members:
        scan, begin = _stretches(image)
        total = across * down
        each = image.interval or total
        want = -(-total // each)
        if len(begin) < want:
            raise ValueError("restart markers are missing")
        data.append(scan)
        starts.append(begin[:want] + at)
        units.append(np.minimum(each, total - each * np.arange(want)))
        spans.append((n, n + want, each))
        at, n = at + len(scan), n + want
    stream = np.concatenate([*data, np.full(8, 255, np.uint8)]).astype(np.uint64)
    window = (stream[:-4] << np.uint64(32)) | (stream[1:-3] << np.uint64(24)) | (stream[2:-2] << np.uint64(16)) | (stream[3:-1] << np.uint64(8)) | stream[4:]
    position, units = np.concatenate(starts) * 8, np.concatenate(units)
    luma = sum(c == 0 for c, _, _ in plan)
    means = np.zeros((n, int(units.max()) * luma), np.int32)
    values = np.zeros((n, 1 + max(c for c, _, _ in plan)), np.int64)
    look = {k: lookup(list(c), list(s)) for k, (c, s) in tables.items()}
    limit = len(window) - 1

    def peek(p: np.ndarray, width: int) -> np.ndarray:
        """The ``width`` <= 32 bits from bit ``p`` on."""
        w = window[np.minimum(p >> 3, limit)]
        return ((w >> (np.uint64(40 - width) - (p & 7).astype(np.uint64))) & np.uint64((1 << width) - 1)).astype(np.int64)

    for unit in range(int(units.max())):
        rows = np.flatnonzero(units > unit)
        whole = len(rows) == n
        for b, (c, dc, ac) in enumerate(plan):
            p = position if whole else position[rows]
            bits = peek(p, 32)
            entry = look[dc][bits >> 16]
            size, length = entry & 255, entry >> 8
            if not length.all() or size.max() > 11:
                raise ValueError("no such code")
            amplitude = (bits >> (32 - length - size)) & ((1 << size) - 1)
            diff = np.where(amplitude < (1 << size) >> 1, amplitude - (1 << size) + 1, amplitude)
            p = p + length + size
            if whole:
                values[:, c] += diff
            else:
                values[rows, c] += diff
            if c == 0:
                slot = unit * luma + b
                means[rows, slot] = values[rows, 0]
            p = _skip_ac(p, look[0x10 | ac], peek)
            if whole:
                position = p
            else:
                position[rows] = p
    if (position > len(window) * 8 + 32).any():
        raise ValueError("the scan ends early")
    for (image, across, down), (first, last, each) in zip(members, spans, strict=True):
        flat = means[first:last, : each * luma].ravel()[: across * down * luma]
        h, v = (image.components[0][1], image.components[0][2]) if len(image.components) > 1 else (1, 1)
        grid = flat.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        step = image.quantisers[image.components[0][3]]
        hmax = max(c[1] for c in image.components) if len(image.components) > 1 else 1
        vmax = max(c[2] for c in image.components) if len(image.components) > 1 else 1
        wide = -(-(-(-image.width * h // hmax)) // 8)
        tall = -(-(-(-image.height * v // vmax)) // 8)
        image.thumbnail = np.clip(np.round(grid[:tall, :wide] * step / 8) + 128, 0, 255).astype(np.uint8)


def _skip_ac(p: np.ndarray, table: np.ndarray, peek) -> np.ndarray:
    """The positions behind the AC symbols of one block each."""
    entry = table[peek(p, 16)]
    if not entry.all():
        raise ValueError("no such code")
    if (entry & 255 == 0).all():  # all blocks end at once
        return p + (entry >> 8)
    p, k, live = p.copy(), np.ones(len(p), np.int64), np.arange(len(p))
    while len(live):
        entry = table[peek(p[live], 16)]
        if not entry.all():
            raise ValueError("no such code")
        symbol, size = entry & 255, entry & 15
        p[live] += (entry >> 8) + size
        k[live] += np.where(symbol == 0, 64, (symbol >> 4) + 1)
        live = live[k[live] < 64]
    return p


def decode(data: bytes) -> list[Image]:
    """All images of a stored form, parsed only."""
    out, at = [], 0
    while at < len(data):
        out.append(parse(data, at))
        at = out[-1].end
    return out


# --- columns --------------------------------------------------------------------------------------------------


def store(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``media``: the text's UTF-8, filled up with bytes 255, as JPEG."""

    def run(batches):
        for batch in batches:
            for part in blocks(sizes(batch.column(1)), BATCH_BYTES):
                raw = [(t or "").encode() for t in batch.column(1)[part].to_pylist()]
                media = [encode_payload(r + b"\xff" * (-len(r) % UNIT if r else UNIT)) for r in raw]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def average_hash(thumbnail: np.ndarray) -> int:
    """64 bits: whether each cell of an 8 x 8 grid over the thumbnail is at least as bright as the whole."""
    rows = np.linspace(0, thumbnail.shape[0], 9).astype(int)
    cols = np.linspace(0, thumbnail.shape[1], 9).astype(int)
    sums = np.zeros((thumbnail.shape[0] + 1, thumbnail.shape[1] + 1), np.int64)
    sums[1:, 1:] = thumbnail.astype(np.int64).cumsum(0).cumsum(1)
    a, b, c, d = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1), cols[:-1], np.maximum(cols[1:], cols[:-1] + 1)
    b, d = np.minimum(b, thumbnail.shape[0]), np.minimum(d, thumbnail.shape[1])
    a, c = np.minimum(a, b - 1), np.minimum(c, d - 1)
    cell = sums[np.ix_(b, d)] - sums[np.ix_(a, d)] - sums[np.ix_(b, c)] + sums[np.ix_(a, c)]
    mean = cell / np.outer(b - a, d - c)
    bits = (mean >= sums[-1, -1] / thumbnail.size).ravel()
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


_COLUMNS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long"


def read(stored: DataFrame) -> DataFrame:
    """Decode the stored bytes: payload digests, dimensions and the thumbnail's hash."""

    def run(batches):
        for batch in batches:
            ids, lengths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in blocks(sizes(batch.column(2)), BATCH_BYTES):
                media = batch.column(2)[part].to_pylist()
                images = [decode(m) for m in media]
                decode_thumbnails([i for one in images for i in one])
                rows = []
                for doc_id, n, m, one in zip(ids[part], lengths[part], media, images, strict=True):
                    payload = b"".join(i.thumbnail.tobytes() for i in one)
                    whole = np.concatenate([i.thumbnail for i in one])
                    rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), f"{average_hash(whole):016x}", one[0].width, sum(i.height for i in one)))
                yield pa.RecordBatch.from_arrays([pa.array(c) if t is None else pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], names=[c.split()[0] for c in _COLUMNS.split(", ")])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, _COLUMNS)


_ARROW = [pa.int64() if c.endswith("long") else pa.string() for c in _COLUMNS.split(", ")]


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every text as JPEG, read the stored bytes back, and describe them."""
    return read(store(docs))
