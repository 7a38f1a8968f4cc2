"""GIF columns: LZW code streams, palettes, disposal and transparency, timed frames and colour histograms.

decode() is a full reader of GIF87a and GIF89a: global and local palettes, interlacing, graphic control (delay, disposal
0 to 3, transparent index) and LZW with deferred clears. encode() writes frames of palette indices. Code widths depend
only on the place since the last clear code, so codes are packed and unpacked as arrays; the dictionary itself is a loop.

A text is stored as an animation of its bytes: the palette holds the byte values that occur, red is the value and green and
blue its kind of character; each frame leaves the one before in place (disposal 1) and draws only the pixels that change,
the others are transparent. So the bytes come back only through palette, transparency and disposal.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, ROWS, DELAY = 192, 64, 10
_LITERALS = [bytes((i,)) for i in range(256)]


def _widths(bits: int, n: int) -> np.ndarray:
    """Code width at each place after a clear code: the reader has added one entry for each code but the first."""
    known = (1 << bits) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.minimum(12, np.floor(np.log2(known)).astype(np.int64) + 1)


_WIDTHS = {b: _widths(b, 8192) for b in range(2, 9)}


def lzw_codes(data: bytes, bits: int = 8) -> list[list[int]]:
    """Codes of data times 256, one list for each stretch between clear codes; a stretch ends before the table is full."""
    base, full = ((1 << bits) + 2) << 8, 4092 << 8
    stretches, codes, table, following = [], [], {}, base
    if not data:
        return [[]]
    # Codes are held times 256, so that a code and the next byte are one key.
    w = data[0] << 8
    get, add = table.get, codes.append
    for b in data[1:]:
        v = get(w | b)
        if v is not None:
            w = v
            continue
        add(w)
        table[w | b] = following
        following += 256
        w = b << 8
        if following == full:
            stretches.append(codes)
            codes, following = [], base
            add = codes.append
            table.clear()
    add(w)
    stretches.append(codes)
    return stretches


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    clear, widths = 1 << bits, _WIDTHS[bits]
    values, sizes = [clear << 8], [np.array([bits + 1])]
    stretches = lzw_codes(data, bits)
    for i, codes in enumerate(stretches):
        values += codes
        values.append((clear if i + 1 < len(stretches) else clear + 1) << 8)
        sizes.append(widths[: len(codes) + 1])
    value, size = np.array(values, np.int64) >> 8, np.concatenate(sizes)
    at = np.cumsum(size) - size
    shifted, byte = value << (at & 7), at >> 3
    total = (int(at[-1] + size[-1]) + 7) // 8
    out = sum(np.bincount(byte + k, shifted >> 8 * k & 255, total + 3) for k in range(3))
    return out[:total].astype(np.uint8).tobytes()


def lzw_decode(data: bytes, bits: int) -> bytes:
    """Bytes of a code stream; ends at the end code or where the data ends."""
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    clear, widths, limit = 1 << bits, _WIDTHS[bits], 8 * len(data)
    first = [bytes((i,)) for i in range(clear)] + [b"", b""]
    out, table, last, place, at = [], first[:], None, 0, 0
    while at < limit:
        # As many codes as the widths since the last clear code give, up to the next control code.
        size = widths[place : place + 4096] if place < 4096 else np.full(4096, 12)
        where = at + np.cumsum(size) - size
        size, where = size[where + size <= limit], where[where + size <= limit]
        if not len(size):
            break
        byte = where >> 3
        codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (where & 7) & (1 << size) - 1
        control = np.flatnonzero((codes == clear) | (codes == clear + 1))
        n = int(control[0]) if len(control) else len(codes)
        stretch = codes[:n].tolist()
        growing, opening = 4096 - len(table) + (last is None), 0
        add = table.append
        if last is None and stretch:
            last, opening = table[stretch[0]], 1
        for c in stretch[opening:growing]:
            try:
                entry = table[c]
            except IndexError:  # the entry that this very code completes
                entry = last + last[:1]
            add(last + entry[:1])
            last = entry
        if stretch[growing:]:
            last = table[stretch[-1]]
        out.append(b"".join(map(table.__getitem__, stretch)))
        if len(control):
            at = int(where[n] + size[n])
            if codes[n] == clear + 1:
                break
            table, last, place = first[:], None, 0
        else:
            at, place = int(where[-1] + size[-1]), place + n
    return b"".join(out)


@dataclass
class Frame:
    """A shown picture: the whole canvas in RGBA, the rectangle drawn (left, top, width, height), its indices, and its time in 1/100 s."""

    canvas: np.ndarray
    box: tuple[int, int, int, int]
    indices: np.ndarray
    delay: int


def encode(frames: list[np.ndarray], palette: np.ndarray, delay: int = DELAY, disposal: int = 1, transparent: int | None = None) -> bytes:
    """A GIF89a file of index pictures with one palette (n x 3) of 4, 8, ... or 256 colours."""
    height, width = max(f.shape[0] for f in frames), max(f.shape[1] for f in frames)
    bits = len(palette).bit_length() - 1
    parts = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF0 | bits - 1, 0, 0), palette.astype(np.uint8).tobytes()]
    for f in frames:
        parts.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (transparent is not None), delay, transparent or 0, 0))
        parts.append(struct.pack("<BHHHHB", 0x2C, 0, 0, f.shape[1], f.shape[0], 0))
        coded = lzw_encode(f.astype(np.uint8).tobytes(), bits)
        parts.append(bytes((bits,)) + b"".join(bytes((len(coded[i : i + 255]),)) + coded[i : i + 255] for i in range(0, len(coded), 255)) + b"\0")
    return b"".join(parts) + b";"


def decode(data: bytes) -> list[Frame]:
    """The timed frames of a GIF file as they are shown, with palettes, transparency and disposal applied."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF file")
    width, height, packed, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None

    def colours(packed: int) -> np.ndarray:
        nonlocal at
        n = 2 << (packed & 7)
        at += 3 * n
        return np.frombuffer(data, np.uint8, 3 * n, at - 3 * n).reshape(n, 3)

    def blocks() -> bytes:
        nonlocal at
        found = []
        while data[at]:
            found.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        at += 1
        return b"".join(found)

    if packed & 0x80:
        shared = colours(packed)
    canvas = np.zeros((height, width, 4), np.uint8)
    frames: list[Frame] = []
    delay, disposal, transparent = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        at += 1
        if kind == 0x21:
            label = data[at]
            at += 1
            content = blocks()
            if label == 0xF9:
                flags, delay, index = struct.unpack_from("<BHB", content)
                disposal, transparent = flags >> 2 & 7, index if flags & 1 else None
        elif kind == 0x2C:
            left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at)
            at += 9
            palette = colours(packed) if packed & 0x80 else shared
            bits = data[at]
            at += 1
            pixels = np.frombuffer(lzw_decode(blocks(), bits)[: w * h].ljust(w * h, b"\0"), np.uint8).reshape(h, w)
            if packed & 0x40:
                rows = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
                pixels = pixels[np.argsort(rows)]
            saved = canvas.copy() if disposal == 3 else None
            colour = np.concatenate([palette, np.zeros((256 - len(palette), 3), np.uint8)])[pixels]
            area = canvas[top : top + h, left : left + w]
            colour = colour[: area.shape[0], : area.shape[1]]
            if transparent is None:
                area[..., :3], area[..., 3] = colour, 255
            else:
                shown = pixels[: area.shape[0], : area.shape[1]] != transparent
                area[shown, :3], area[shown, 3] = colour[shown], 255
            frames.append(Frame(canvas.copy(), (left, top, w, h), pixels, delay))
            if disposal == 2:
                canvas[top : top + h, left : left + w] = 0
            elif disposal == 3:
                canvas = saved
            delay, disposal, transparent = 0, 0, None
        else:
            raise ValueError(f"unknown block {kind:#x}")
    return frames


def histogram(frame: Frame) -> np.ndarray:
    """Counts of the 64 colours that two bits of each channel make, over the rectangle drawn."""
    left, top, w, h = frame.box
    rgb = frame.canvas[top : top + h, left : left + w, :3].astype(np.int64) >> 6
    return np.bincount((rgb[..., 0] * 16 + rgb[..., 1] * 4 + rgb[..., 2]).ravel(), minlength=64)


def _colours() -> np.ndarray:
    """A colour for each byte value: red the value, green whether it is a blank, letter, digit or other sign, blue whether it is a capital or not ASCII."""
    value = np.arange(256)
    small, capital, digit = ((value >= ord(a)) & (value <= ord(z)) for a, z in ("az", "AZ", "09"))
    green = np.select([value <= 32, small | capital | (value > 127), digit], [0, 64, 128], 192)
    return np.stack([value, green, np.select([capital, value > 127], [128, 192], 0)], axis=1).astype(np.uint8)


COLOURS = _colours()


def store(payload: bytes) -> bytes:
    """A GIF that shows the bytes of payload (a positive multiple of WIDTH), ROWS rows to a frame."""
    data = np.frombuffer(payload, np.uint8)
    values = np.flatnonzero(np.bincount(data, minlength=256))
    more = len(data) > WIDTH * ROWS and len(values) < 256
    bits = max(2, (len(values) + more - 1).bit_length())
    palette, index = np.zeros((1 << bits, 3), np.uint8), np.zeros(256, np.uint8)
    palette[: len(values)], index[values] = COLOURS[values], np.arange(len(values))
    pixels = index[data].reshape(-1, WIDTH)
    frames = [pixels[:ROWS]]
    for i in range(ROWS, len(pixels), ROWS):
        own = pixels[i : i + ROWS]
        frames.append(np.where(own == pixels[i - ROWS : i - ROWS + len(own)], np.uint8(len(values)), own) if more else own)
    return encode(frames, palette, transparent=len(values) if more else None)


def load(frames: list[Frame]) -> bytes:
    """The payload of store(): the red channel of what each frame shows."""
    return b"".join(f.canvas[f.box[1] : f.box[1] + f.box[3], f.box[0] : f.box[0] + f.box[2], 0].tobytes() for f in frames)


SCHEMA = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "frames array<struct<at_cs:long,delay_cs:int,width:int,height:int,histogram:array<int>>>"
)
_FIELDS = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())


def describe(text: str | None) -> tuple[tuple, np.ndarray, np.ndarray, bytes]:
    """The values of _FIELDS, a row of at_cs, delay_cs, width and height for each frame, the frames' histograms, and the file."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    media = store(raw + b" " * (-len(raw) % WIDTH if raw else WIDTH))
    frames = decode(media)
    back = load(frames)
    counts = np.stack([histogram(f) for f in frames])
    facts = np.array([(0, f.delay, f.box[2], f.box[3]) for f in frames])
    facts[1:, 0] = np.cumsum(facts[:-1, 1])
    total = counts.sum(axis=0)
    seen = ",".join(f"{i}:{total[i]}" for i in np.flatnonzero(total))
    feature = f"frames={len(frames)};time_cs={facts[:, 1].sum()};colours={seen}"
    values = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature)
    return values, facts, counts, media


def _frames(facts: list[np.ndarray], counts: list[np.ndarray]) -> pa.Array:
    """The column of frames: a list for each row."""
    flat, histograms = np.concatenate(facts), np.concatenate(counts).astype(np.int32)
    ends = pa.array(np.arange(0, histograms.size + 1, 64), pa.int32())
    each = pa.StructArray.from_arrays(
        [pa.array(flat[:, 0]), *(pa.array(flat[:, i].astype(np.int32)) for i in (1, 2, 3)), pa.ListArray.from_arrays(ends, pa.array(histograms.ravel()))],
        names=["at_cs", "delay_cs", "width", "height", "histogram"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, facts)]), pa.int32()), each)


def gif_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """doc_id and SCHEMA (and the file itself as ``media``) for every row: the text's bytes stored as a GIF and read back.

    Null text counts as empty, which is one row of spaces. Repeated rows and null ids all appear. An empty table gives
    an empty result; other columns are ignored. A long text is many frames; one text is held at a time.
    """
    kind = docs.schema["doc_id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                values, facts, counts, media = zip(*(describe(t.as_py()) for t in part.column(1)))
                columns = [pa.array(c, t) for c, t in zip(zip(*values), _TYPES)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, _frames(facts, counts), *[pa.array(media, pa.binary())] * keep_media],
                                                 names=["doc_id", *_FIELDS, "frames", *["media"] * keep_media])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, f"doc_id {kind.simpleString()}, {SCHEMA}" + ", media binary" * keep_media)
