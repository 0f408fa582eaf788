"""GIF media columns: LZW code streams, palettes, disposal, transparency, timed frames, colour histograms.

``decode`` reads any GIF87a or GIF89a stream: local and global palettes, interlace, deferred
clears, transparent indices, the four disposal methods and frame delays. ``encode`` stores bytes
losslessly as palette indices with a grey palette, 64 samples a row and at most ``ROWS`` rows a
frame. ``text_media`` does both for a text column; ``frames`` explodes stored media to one row a
frame with its time and histogram columns.

Defined results: a null text counts as empty; the payload is the text's UTF-8 bytes with zeros up
to a positive multiple of 64. Repeated rows are all returned. Null media has no frames; broken
media raises ``GifError`` in ``decode`` and has a null frame list in ``frames``.
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

from quillgraph.llm.common import bound_batches

#: Samples in a row of a stored payload, and the multiple that it is padded to.
WIDTH = 64
#: Rows in a frame of a stored payload.
ROWS = 512
#: Hundredths of a second that a stored frame lasts.
DELAY = 10
#: Histogram bins for each colour channel.
BINS = 8
#: Codes of a GIF code stream have at most this many bits.
MOST_BITS = 12
GREY = bytes(x for i in range(256) for x in (i, i, i))


class GifError(ValueError):
    """The bytes are not a readable GIF."""


@dataclass
class Frame:
    """One frame: its place in time and on the canvas, its indices, and the canvas once it is drawn."""

    start_ms: int
    delay_ms: int
    left: int
    top: int
    indices: np.ndarray
    canvas: np.ndarray


def _code_widths(first: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the codes after a clear, and where each begins in bits, for codes that begin with ``first`` bits."""
    free = (1 << (first - 1)) + 1 + np.arange(1 << (MOST_BITS + 1))
    widths = np.full(free.size, first)
    for bits in range(first, MOST_BITS):
        widths[free >= 1 << bits] = bits + 1
    return widths, np.concatenate(([0], np.cumsum(widths)[:-1]))


_WIDTHS = {first: _code_widths(first) for first in range(2, MOST_BITS + 1)}


def lzw_encode(data: bytes) -> bytes:
    """The code stream for 8-bit samples; the table is cleared when full."""
    codes, sizes = [], []
    append, table, free, done = codes.append, {}, 258, 0
    get = table.get
    held = data[0]
    for b in data[1:]:
        key = held << 8 | b
        code = get(key)
        if code is not None:
            held = code
            continue
        append(held)
        table[key] = free
        free += 1
        held = b
        if free == 1 << MOST_BITS:
            append(256)
            table.clear()
            free = 258
            sizes.append(len(codes) - done)
            done = len(codes)
    append(held)
    append(257)
    sizes.append(len(codes) - done)
    widths = np.concatenate([[9], *[_WIDTHS[9][0][:n] for n in sizes]])
    values = np.array([256, *codes], dtype=np.uint16)
    bits = np.unpackbits(values.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16) < widths[:, None]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, first_bits: int, most: int) -> bytes:
    """The samples of a code stream whose literals have ``first_bits`` bits; no more than ``most``."""
    clear, stop = 1 << first_bits, (1 << first_bits) + 1
    widths, offsets = _WIDTHS[first_bits + 1]
    data = np.frombuffer(stream + b"\0" * 4, dtype=np.uint8).astype(np.uint32)
    end, at, out, size = len(stream) * 8, 0, [], 0
    literals = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, last, seen = list(literals), None, 0
    while at < end and size < most:
        take = min(1024, widths.size - seen) if seen < widths.size else 1024
        if seen < widths.size:
            wide, where = widths[seen : seen + take], at + offsets[seen : seen + take] - offsets[seen]
        else:
            wide, where = np.full(take, MOST_BITS), at + MOST_BITS * np.arange(take)
        whole = int(np.searchsorted(where + wide, end, side="right"))
        if not whole:
            break
        wide, where = wide[:whole], where[:whole]
        byte = where >> 3
        word = data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16
        codes = (word >> (where & 7).astype(np.uint32)) & ((1 << wide) - 1).astype(np.uint32)
        marks = np.flatnonzero((codes == clear) | (codes == stop))
        upto = int(marks[0]) if marks.size else whole
        for code in codes[:upto].tolist():
            if code < len(table):
                entry = table[code]
            elif code == len(table) and last is not None:
                entry = last + last[:1]
            else:
                raise GifError(f"code {code} is not in the table")
            out.append(entry)
            size += len(entry)
            if last is not None and len(table) < 1 << MOST_BITS:
                table.append(last + entry[:1])
            last = entry
        if not marks.size:
            at, seen = int(where[-1] + wide[-1]), seen + whole
        elif codes[upto] == clear:
            at, seen, last = int(where[upto] + wide[upto]), 0, None
            table = list(literals)
        else:
            break
    return b"".join(out)[:most]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode(payload: bytes) -> bytes:
    """A GIF89a whose frames hold the payload, a positive multiple of 64 bytes, as grey indices."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), GREY]
    for at in range(0, rows, ROWS):
        part = payload[at * WIDTH : (at + ROWS) * WIDTH]
        out += [b"\x21\xf9\x04", struct.pack("<BHBB", 1 << 2, DELAY, 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


def _read_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    size = 2 << (flags & 7)
    found = np.zeros((256, 3), dtype=np.uint8)
    found[:size] = np.frombuffer(data[at : at + 3 * size], dtype=np.uint8).reshape(size, 3)
    return found, at + 3 * size


def decode(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF, one at a time, each with the canvas as shown."""
    try:
        yield from _decode(data)
    except (IndexError, struct.error, KeyError) as e:
        raise GifError(f"the stream ends early or is broken: {e}") from e
    except ValueError as e:
        raise e if isinstance(e, GifError) else GifError(str(e)) from e


def _decode(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise GifError("no GIF signature")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, common = 13, None
    if flags & 0x80:
        common, at = _palette(data, at, flags)
    canvas = np.zeros((height, width, 3), dtype=np.uint8)
    start, delay, disposal, clear_index = 0, 0, 0, None
    while data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            if data[at + 1] == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", data, at + 3)
                disposal, clear_index = packed >> 2 & 7, index if packed & 1 else None
            _, at = _read_blocks(data, at + 2)
            continue
        if kind != 0x2C:
            raise GifError(f"unknown block {kind:#x}")
        left, top, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        colours = common
        if local & 0x80:
            colours, at = _palette(data, at, local)
        if colours is None:
            raise GifError("a frame has no palette")
        bits = data[at]
        stream, at = _read_blocks(data, at + 1)
        samples = lzw_decode(stream, bits, w * h)
        if len(samples) < w * h:
            raise GifError("a frame has too few samples")
        indices = np.frombuffer(samples, dtype=np.uint8).reshape(h, w)
        if local & 0x40:
            order = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
            straight = np.empty_like(indices)
            straight[order] = indices
            indices = straight
        before = canvas.copy() if disposal == 3 else None
        shown = indices[: max(0, height - top), : max(0, width - left)]
        area = canvas[top : top + h, left : left + w]
        drawn = colours[shown]
        area[...] = drawn if clear_index is None else np.where((shown == clear_index)[..., None], area, drawn)
        yield Frame(start * 10, delay * 10, left, top, indices, canvas)
        if disposal == 2:
            area[...] = 0
        elif before is not None:
            canvas = before
        start += delay
        delay, disposal, clear_index = 0, 0, None


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Counts of the canvas's pixels in ``BINS`` equal bins of red, green and blue."""
    width = 256 // BINS
    return np.stack([np.bincount((canvas[..., c] // width).ravel(), minlength=BINS) for c in range(3)])


def payload_of(raw: bytes | None) -> bytes:
    """A text's bytes with zeros up to a positive multiple of 64."""
    raw = raw or b""
    return raw + b"\0" * (-len(raw) % WIDTH if raw else WIDTH)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Store every text as a GIF, read the stored bytes back and describe both; ``keep_media`` adds the GIF."""
    bound_batches(docs.sparkSession)

    def describe(raw: bytes | None) -> tuple:
        media = encode(payload_of(raw))
        parts, bins, last = [], np.zeros((3, BINS), dtype=np.int64), 0
        for frame in decode(media):
            parts.append(frame.indices.tobytes())
            bins += histogram(frame.canvas[: frame.indices.shape[0]])
            last = frame.start_ms + frame.delay_ms
        back = b"".join(parts)
        feature = f"frames={len(parts)} ms={last} " + " ".join(f"{c}={','.join(map(str, row))}" for c, row in zip("rgb", bins.tolist(), strict=True))
        sums = hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature
        return (len(raw or b""), len(back), *sums, len(parts), last, media if keep_media else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [describe(t.as_py()) for t in b.column(1)]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=names)

    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "duration_ms", "media"][: 11 if keep_media else 10]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()][: len(names) - 1]
    schema = f"doc_id {given.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_frames bigint, duration_ms bigint" + ", media binary" * keep_media
    return given.mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)


def frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row a frame of every GIF: number, start, delay, place, size, and the canvas's colour histograms."""
    bound_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, cell in zip(b.column(0), b.column(1), strict=True):
                rows = []
                try:
                    for n, f in enumerate(decode(cell.as_py()) if cell.as_py() is not None else ()):
                        rows.append({"frame": n, "start_ms": f.start_ms, "delay_ms": f.delay_ms, "left": f.left, "top": f.top, "width": f.indices.shape[1], "height": f.indices.shape[0], **dict(zip(("red", "green", "blue"), histogram(f.canvas).tolist(), strict=True))})
                except GifError:
                    rows = [dict.fromkeys(kinds.names)]
                if rows:
                    cells = pa.Table.from_pylist(rows, schema=kinds)
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(rows), b.column(0).type), *[c.combine_chunks() for c in cells.columns]], names=["doc_id", *kinds.names])

    ints = ["frame", "start_ms", "delay_ms", "left", "top", "width", "height"]
    kinds = pa.schema([*[(n, pa.int64()) for n in ints], *[(c, pa.list_(pa.int64())) for c in ("red", "green", "blue")]])
    given = media.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("m"))
    schema = f"doc_id {given.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"`{n}` bigint" for n in ints) + ", red array<bigint>, green array<bigint>, blue array<bigint>"
    return given.mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)
