"""GIF media columns: frames are decoded from LZW code streams, with palettes, disposal and transparency applied, and
stored with their times and colour histograms. The writer stores bytes losslessly as 8-bit samples, one grey a byte."""

from __future__ import annotations

import contextlib
import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CLEAR, _END, _FIRST, _CODES = 256, 257, 258, 4096
#: A canvas or frame of more pixels counts as broken: heads of damaged files can claim four thousand million.
MOST_PIXELS = 1 << 26


@functools.cache
def _layout(low: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(width, first bit) of the codes 0..n-1 after a clear code, for a least code size. A reader's table grows by one with
    each code but the first, and the width with it, up to 12 bits."""
    nxt = (1 << low) + 2 + np.maximum(0, np.arange(n) - 1)
    width = np.minimum(12, np.maximum(low + 1, np.floor(np.log2(nxt)).astype(np.int64) + 1))
    return width, np.concatenate([[0], np.cumsum(width)])


def lzw_codes(data: bytes) -> np.ndarray:
    """The code of each phrase of 8-bit samples, with clear codes whenever the table is full."""
    if not data:
        return np.array([_CLEAR, _END], np.uint16)
    codes, table, nxt, prefix = [_CLEAR], {}, _FIRST, data[0]
    emit, get = codes.append, table.get
    for b in memoryview(data)[1:]:
        key = prefix << 8 | b
        known = get(key)
        if known is not None:
            prefix = known
            continue
        emit(prefix)
        if nxt < _CODES:
            table[key] = nxt
            nxt += 1
        else:
            emit(_CLEAR)
            table, nxt = {}, _FIRST
            get = table.get
        prefix = b
    emit(prefix)
    emit(_END)
    return np.array(codes, np.uint16)


def lzw_pack(codes: np.ndarray) -> bytes:
    """Codes as a bit stream, each as wide as a reader expects it at its place after the last clear code."""
    c = codes
    i = np.arange(len(c))
    last = np.maximum.accumulate(np.where(c == _CLEAR, i, 0))
    since = np.where(c == _CLEAR, 0, i - last - 1)
    # a clear code itself has the width of its own place after the clear code before it
    prior = np.concatenate([[0], last[:-1]])
    since = np.where((c == _CLEAR) & (i > 0), i - prior - 1, since)
    width = _layout(8, 4200)[0][np.minimum(since, 4199)]
    width[0] = 9
    bits = (c[:, None] >> np.arange(12, dtype=np.uint16)) & 1
    return np.packbits(bits[np.arange(12) < width[:, None]].astype(np.uint8), bitorder="little").tobytes()


def lzw_unpack(stream: bytes, low: int, most: int) -> bytes:
    """The samples of a code stream of least code size ``low``; it ends with the end code, the stream or ``most`` samples."""
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.uint32)
    triple = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    clear, end, whole, out, size, at, place = 1 << low, (1 << low) + 1, 8 * len(stream), [], 0, 0, 0
    base = [bytes([i]) if i < clear else b"" for i in range(clear + 2)]
    table, prior = list(base), b""
    while at < whole and size < most:
        n = 4200
        width, first = _layout(low, place + n)
        width, first = width[place:], first[place:] - first[place]
        n = int(np.searchsorted(first[1:], whole - at, "right"))
        if not n:
            break
        bit = at + first[:n]
        codes = triple[bit >> 3] >> (bit & 7).astype(np.uint32) & ((1 << width[:n]) - 1).astype(np.uint32)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        ended = bool(len(stop))
        run = codes[: stop[0] if ended else n].tolist()
        if run and not prior:
            prior = table[run[0]] if run[0] < clear else b""
            out.append(prior)
            size += len(prior)
            run = run[1:]
        known, keep, grow = len(table), out.append, table.append
        for code in run:
            entry = table[code] if code < known else prior + prior[:1]
            if known < _CODES:
                grow(prior + entry[:1])
                known += 1
            keep(entry)
            prior = entry
        size += sum(map(len, out[-len(run) :])) if run else 0
        if not ended:
            at, place = at + int(first[n]), place + n
            continue
        at += int(first[stop[0] + 1])
        if codes[stop[0]] == end:
            break
        table, prior, place = list(base), b"", 0
    return b"".join(out)[:most]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode_gif(samples: bytes, width: int = 192, height: int = 256, delay: int = 10) -> bytes:
    """Samples (a multiple of width) as frames of at most width x height with a palette of 256 greys, each kept by the next."""
    rows = len(samples) // width
    greys = bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, height), 0xF7, 0, 0), greys]
    for top in range(0, rows, height):
        part = samples[top * width : (top + height) * width]
        out += [b"\x21\xf9\x04\x04", struct.pack("<HB", delay, 0), b"\0\x2c", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0), b"\x08", _blocks(lzw_pack(lzw_codes(part)))]
    return b"".join([*out, b"\x3b"])


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def decode_gif(data: bytes) -> Iterator[dict]:
    """A dict a frame: its place and size, delay, start time (both in hundredths of a second), disposal, and the canvas
    (height x width x 3) as shown then. Interlaced rows are put in order. Data that isn't GIF has no frame; data that
    breaks off gives the frames before the break."""
    with contextlib.suppress(IndexError, ValueError, struct.error):
        yield from _frames(data)


def _frames(data: bytes) -> Iterator[dict]:
    """As decode_gif; data that breaks off raises an error where it does."""
    if data[:3] != b"GIF" or len(data) < 13:
        return
    wide, high, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    if wide * high > MOST_PIXELS:
        return
    at, shared = 13, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        shared, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
    back = shared[background] if shared is not None and background < len(shared) else np.zeros(3, np.uint8)
    canvas = np.empty((high, wide, 3), np.uint8)
    canvas[:] = back
    delay, disposal, clear, time, k = 0, 0, None, 0, 0
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9:
                bits, delay, index = struct.unpack_from("<BHB", data, at + 3)
                disposal, clear = bits >> 2 & 7, index if bits & 1 else None
            _, at = _sub_blocks(data, at + 2)
            continue
        if data[at] != 0x2C:
            return
        left, top, w, h, bits = struct.unpack_from("<HHHHB", data, at + 1)
        at, palette = at + 10, shared
        if bits & 0x80:
            n = 3 << ((bits & 7) + 1)
            palette, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
        low = data[at]
        stream, at = _sub_blocks(data, at + 1)
        if w * h > MOST_PIXELS or not 1 <= low <= 8 or not data[at - 1 : at] or data[at - 1]:
            raise ValueError("a frame breaks off")
        pixels = np.frombuffer(lzw_unpack(stream, low, w * h).ljust(w * h, b"\0"), np.uint8).reshape(h, w)
        if bits & 0x40:
            rows = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            pixels = pixels[np.argsort(rows)]
        prior = canvas.copy() if disposal == 3 else None
        if palette is None:
            palette = np.zeros((256, 3), np.uint8)
        shown = canvas[top : top + h, left : left + w]
        pixels = pixels[: shown.shape[0], : shown.shape[1]]
        drawn = palette[np.minimum(pixels, len(palette) - 1)]
        shown[:] = drawn if clear is None else np.where((pixels == clear)[..., None], shown, drawn)
        yield {"frame": k, "left": left, "top": top, "width": w, "height": h, "delay": delay, "start": time, "disposal": disposal, "canvas": canvas.copy()}
        if disposal == 2:
            shown[:] = back
        elif disposal == 3:
            canvas = prior
        time, k, delay, disposal, clear = time + delay, k + 1, 0, 0, None


def histogram(canvas: np.ndarray, bins: int = 16) -> list[int]:
    """Counts of each channel's values in equal bins, red then green then blue."""
    return np.concatenate([np.bincount(canvas[..., c].ravel().astype(np.int64) * bins // 256, minlength=bins) for c in range(3)]).tolist()


FRAMES = "frame int, left int, top int, width int, height int, start_cs int, delay_cs int, disposal int, pixels binary, histogram array<long>"


def media_frames(df: DataFrame, id_column: str, media: str) -> DataFrame:
    """A row a frame of each GIF: id, FRAMES. ``pixels`` is the RGB canvas as shown; null media has no row, and
    media that breaks off has its frames before the break."""
    names = [x.split(" ")[0] for x in FRAMES.split(", ")]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0), batch.column(1), strict=True):
                for f in decode_gif(data.as_py() or b""):
                    row = (f["frame"], f["left"], f["top"], f["width"], f["height"], f["start"], f["delay"], f["disposal"], f["canvas"].tobytes(), histogram(f["canvas"]))
                    kinds = [pa.int32()] * 8 + [pa.binary(), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], batch.schema.field(0).type), *[pa.array([x], k) for x, k in zip(row, kinds, strict=True)]], names=[id_column, *names])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(F.col(id_column), F.col(media).cast("binary")).mapInArrow(decode, f"`{id_column}` {kind}, {FRAMES}")


STORED = "n_bytes long, payload_bytes long, media binary, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(text: bytes, unit: int = 192) -> bytes:
    """The bytes with spaces up to a positive multiple of the unit."""
    return text.ljust(max(1, -(-len(text) // unit)) * unit)


def store_text(text: bytes) -> tuple:
    """The columns of STORED: a GIF of the padded bytes, and what the frames of that GIF give when read back."""
    media = encode_gif(padded(text))
    parts, total, times = [], np.zeros(48, np.int64), 0
    for f in decode_gif(media):
        shown = f["canvas"][f["top"] : f["top"] + f["height"], f["left"] : f["left"] + f["width"]]
        parts.append(shown[..., 0].tobytes())
        total += histogram(shown)
        times += f["delay"]
    payload = b"".join(parts)
    feature = f"{len(parts)} frames {times} cs " + ",".join(map(str, total[:16].tolist()))
    return len(text), len(payload), media, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature


def text_media(df: DataFrame, id_column: str, text: str, with_media: bool = True) -> DataFrame:
    """id, STORED: each text (null: empty) stored as a GIF and read back from it. ``media`` is null unless asked for."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = [x.split(" ")[0] for x in STORED.split(", ")], [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                rows = [store_text((t.as_py() or "").encode()) for t in part.column(1)]
                columns = list(zip(*rows, strict=True))
                if not with_media:
                    columns[2] = [None] * len(rows)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[id_column, *names])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(F.col(id_column), F.col(text)).mapInArrow(store, f"`{id_column}` {kind}, {STORED}")
