"""Operator 3, GIF media columns.

Decoding walks the blocks of a GIF87a/89a byte string, decodes each image's LZW code stream, applies the
local or global palette, transparency, interlacing and disposal, and gives timed frames as they are
shown: RGBA canvas, delay and a colour histogram (64 bins, two bits of each of R, G and B; the
transparent part of the canvas counts in none). Encoding writes 8-bit samples as an animation with a grey
palette, so that any byte string survives a round trip.

Nothing is shuffled. A worker gets a few rows at a time (``common.BATCH``) and shows one canvas after the other;
``decode_frames`` gives a row per frame, handed on before many are held, ``decode_column`` keeps no pixels. Images of
any size are cut into frames of at most ``FRAME_ROWS`` rows when encoded.

Defined cases: null media decode to null (``decode_frames``: no row); an empty or broken GIF, or one that claims more than
``max_pixels`` in its canvas or an image, gives the frames before the fault and an ``error``; code streams that end early
leave the rest of the image undrawn; very long texts are a longer animation; repeated rows and null ids are kept and
equal media give equal values; an empty table gives an empty result; other columns are not looked at, helper columns take names
that the input lacks, and an output name that the input has raises.
"""

from __future__ import annotations

import zlib
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, map_texts, small_batches, table

WIDTH, FRAME_ROWS, DELAY_CS = 192, 256, 10
#: Pixels of a canvas or an image that a file may ask for: 64 MB as RGBA.
MAX_PIXELS = 1 << 24
CLEAR, END, FIRST, LIMIT = 256, 257, 258, 4096
GREY = bytes(v for i in range(256) for v in (i, i, i))


# Code streams ------------------------------------------------------------------------------------


def _widths(min_size: int, n: int) -> np.ndarray:
    """Bits of the n codes that follow a clear code: the reader's table grows by one from the second on."""
    first = (1 << min_size) + 2
    size = first - 1 + np.arange(n)
    size[:1] = first
    return np.clip(np.floor(np.log2(size)).astype(np.int64) + 1, min_size + 1, 12)


_W8 = _widths(8, LIMIT)
_OFF8 = np.concatenate([[0], np.cumsum(_W8)])


def lzw_encode(data: bytes) -> bytes:
    """8-bit samples as a GIF code stream; the table is cleared when it is full."""
    codes: list[int] = []
    ends: list[int] = []
    emit = codes.append
    at, n = 0, len(data)
    it = iter(data)
    w = next(it, None)
    table: dict[int, int] = {}
    get, size = table.get, FIRST
    if w is not None:
        for b in it:
            key = w << 8 | b
            hit = get(key)
            if hit is not None:
                w = hit
            else:
                emit(w)
                table[key] = size
                size += 1
                w = b
                if size == LIMIT:
                    emit(CLEAR)
                    ends.append(len(codes))
                    table.clear()
                    size = FIRST
        emit(w)
    emit(END)
    ends.append(len(codes))
    parts, at = [np.array([9])], 0
    for end in ends:
        parts.append(_W8[: end - at])
        at = end
    width = np.concatenate(parts)
    code = np.array([CLEAR, *codes], dtype=np.int64)
    bits = (code[:, None] >> np.arange(12)) & 1
    keep = np.arange(12) < width[:, None]
    return np.packbits(bits[keep].astype(np.uint8), bitorder="little").tobytes()


def lzw_decode(data: bytes, min_size: int, n_pixels: int) -> bytes:
    """At most n_pixels samples of a code stream; less if it ends early or holds an unknown code."""
    clear, end = 1 << min_size, (1 << min_size) + 1
    raw = np.frombuffer(data + b"\0\0\0\0", dtype=np.uint8).astype(np.int64)
    total = 8 * len(data)
    if min_size == 8:
        width, offset = _W8, _OFF8
    else:
        width = _widths(min_size, LIMIT)
        offset = np.concatenate([[0], np.cumsum(width)])
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    made, bit = 0, 0
    entries, prev = list(base), b""
    step = 0  # codes since the last clear
    while made < n_pixels:
        # The codes up to the next clear have known widths: read them all at once.
        if step >= LIMIT:
            w = np.full(LIMIT, 12)
            off = bit + 12 * np.arange(LIMIT)
        else:
            w = width[step:]
            off = bit + offset[step:-1] - offset[step]
        ok = off + w <= total
        off, w = off[ok], w[ok]
        if not len(off):
            break
        i = off >> 3
        codes = ((raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) >> (off & 7)) & ((1 << w) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stop[0]) if len(stop) else len(codes)
        size = len(entries)
        append, put = out.append, entries.append
        for c in codes[:n].tolist():
            if c < size:
                e = entries[c]
            elif c == size and prev:
                e = prev + prev[:1]
            else:
                return b"".join(out)[:n_pixels]
            if prev and size < LIMIT:
                put(prev + e[:1])
                size += 1
            append(e)
            made += len(e)
            prev = e
        if not len(stop):
            bit = int(off[-1] + w[-1])
            step += len(codes)
            continue
        if int(codes[n]) == end:
            break
        bit = int(off[n] + w[n])
        entries, prev, step = list(base), b"", 0
    return b"".join(out)[:n_pixels]


# Whole files -------------------------------------------------------------------------------------


def _sub_blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode_gif(samples: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """Samples, a multiple of width, as an animation of grey frames from the top; its last may be lower."""
    rows = len(samples) // width
    out = [b"GIF89a", width.to_bytes(2, "little"), min(rows, frame_rows).to_bytes(2, "little"), b"\xf7\0\0", GREY]
    for top in range(0, rows, frame_rows):
        n = min(frame_rows, rows - top)
        out.append(b"\x21\xf9\x04\x04" + delay_cs.to_bytes(2, "little") + b"\0\0")  # disposal 1: leave in place
        out.append(b"\x2c\0\0\0\0" + width.to_bytes(2, "little") + n.to_bytes(2, "little") + b"\0\x08")
        out.append(_sub_blocks(lzw_encode(samples[top * width : (top + n) * width])))
    return b"".join([*out, b"\x3b"])


def frames_of(data: bytes, max_pixels: int = MAX_PIXELS):
    """(RGBA canvas, place x, y, w, h, delay in ms, disposal) of each frame as shown. ValueError if broken or too large."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    num = lambda at: int.from_bytes(data[at : at + 2], "little")
    width, height, flags = num(6), num(8), data[10]
    at, palette = 13, None

    def colours(n_bits: int) -> np.ndarray:
        nonlocal at
        n = 3 << (n_bits + 1)
        if at + n > len(data):
            raise ValueError("the palette ends early")
        out = np.zeros((256, 4), np.uint8)
        got = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3)
        out[: len(got), :3], out[: len(got), 3] = got, 255
        at += n
        return out

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while at < len(data) and data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        at += 1
        return b"".join(parts)

    if flags & 0x80:
        palette = colours(flags & 7)
    if width * height > max_pixels:
        raise ValueError(f"a canvas of more than {max_pixels} pixels")
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, clear_index = 0, 0, None
    while at < len(data):
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at] if at < len(data) else 0
            at += 1
            body = blocks()
            if label == 0xF9 and len(body) >= 4:
                disposal = body[0] >> 2 & 7
                delay = int.from_bytes(body[1:3], "little") * 10
                clear_index = body[3] if body[0] & 1 else None
        elif kind == 0x2C:
            if at + 9 > len(data):
                raise ValueError("the image ends early")
            x, y, w, h, local = num(at), num(at + 2), num(at + 4), num(at + 6), data[at + 8]
            at += 9
            own = colours(local & 7) if local & 0x80 else palette
            if own is None:
                raise ValueError("an image without a palette")
            size = data[at] if at < len(data) else 0
            at += 1
            if not 1 <= size <= 8:
                raise ValueError("a code size out of range")
            if w * h > max_pixels:
                raise ValueError(f"an image of more than {max_pixels} pixels")
            pixels = np.frombuffer(lzw_decode(blocks(), size, w * h), np.uint8)
            index = np.zeros(w * h, np.uint8)
            drawn = np.zeros(w * h, bool)
            index[: len(pixels)], drawn[: len(pixels)] = pixels, True
            index, drawn = index.reshape(h, w), drawn.reshape(h, w)
            if local & 0x40:
                order = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
                back = np.empty(h, np.int64)
                back[order] = np.arange(h)
                index, drawn = index[back], drawn[back]
            if clear_index is not None:
                drawn = drawn & (index != clear_index)
            before = canvas.copy() if disposal == 3 else None
            hh, ww = max(0, min(h, height - y)), max(0, min(w, width - x))
            place = canvas[y : y + hh, x : x + ww]
            seen = drawn[:hh, :ww]
            place[seen] = own[index[:hh, :ww]][seen]
            yield canvas.copy(), x, y, w, h, delay, disposal
            if disposal == 2:
                place[:] = 0
            elif disposal == 3:
                canvas = before
            delay, disposal, clear_index = 0, 0, None
        elif kind:
            raise ValueError(f"an unknown block {kind}")


def histogram(canvas: np.ndarray) -> np.ndarray:
    rgb = (canvas[..., :3] >> 6).astype(np.int64)
    return np.bincount((rgb[..., 0] * 16 + rgb[..., 1] * 4 + rgb[..., 2])[canvas[..., 3] > 0], minlength=64)


FRAME = "at_ms:int,delay_ms:int,x:int,y:int,width:int,height:int,disposal:int,histogram:array<long>"


def _frames(data: bytes, max_pixels: int):
    """(a frame's row without pixels, its canvas) of each frame, then (None, the error) if the file is broken."""
    at = 0
    try:
        for canvas, x, y, w, h, delay, disposal in frames_of(data, max_pixels):
            yield {"at_ms": at, "delay_ms": delay, "x": x, "y": y, "width": w, "height": h, "disposal": disposal, "histogram": histogram(canvas).tolist()}, canvas
            at += delay
    except (ValueError, IndexError) as e:
        yield None, str(e)


def decode_column(df: DataFrame, media_col: str, out_col: str = "frames", max_pixels: int = MAX_PIXELS) -> DataFrame:
    """Adds the timed frames (without pixels) of a column of GIF byte strings, and ``<out_col>_error`` for broken ones."""
    if clash := {out_col.lower(), f"{out_col}_error".lower()} & {c.lower() for c in df.columns}:
        raise ValueError(f"the input has {sorted(clash)} already")
    small_batches(df.sparkSession)

    @F.pandas_udf(f"frames array<struct<{FRAME}>>, error string")
    def run(media):
        import pandas as pd

        rows = []
        for data in media:
            got = [] if data is None else list((f, c if f is None else None) for f, c in _frames(bytes(data), max_pixels))
            rows.append((None, None) if data is None else ([f for f, _ in got if f], next((c for f, c in got if f is None), None)))
        return pd.DataFrame(rows, columns=["frames", "error"])

    name = fresh(df, "_gif")
    got = df.withColumn(name, run(media_col))
    return got.select(*df.columns, F.col(name)["frames"].alias(out_col), F.col(name)["error"].alias(f"{out_col}_error"))


def decode_frames(df: DataFrame, id_col: str, media_col: str, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """A row per frame with its pixels: id, frame (number), the timed frame, rgba; a broken file ends in a row with error."""
    small_batches(df.sparkSession)
    fields = [f.split(":") for f in FRAME.split(",")]
    src = df.select(F.col(id_col).alias("_id"), F.col(media_col).alias("_m"))
    kind = src.schema["_id"].dataType.simpleString()
    out = f"_id {kind}, frame int, {', '.join(f'{n} {t}' for n, t in fields)}, rgba binary, error string"

    def run(batches):
        import pyarrow as pa

        types = [pa.list_(pa.int64()) if t.startswith("array") else pa.int32() for _, t in fields]
        for batch in batches:
            for row in range(batch.num_rows):
                data = batch.column("_m")[row].as_py()
                for k, (frame, canvas) in enumerate(_frames(data, max_pixels) if data is not None else ()):
                    values = [pa.array([frame and frame[n]], t) for (n, _), t in zip(fields, types, strict=True)]
                    shown = [pa.array([canvas.tobytes() if frame else None], pa.binary()), pa.array([None if frame else canvas], pa.string())]
                    yield pa.RecordBatch.from_arrays([batch.column("_id").slice(row, 1), pa.array([k], pa.int32()), *values, *shown], names=["_id", "frame", *[n for n, _ in fields], "rgba", "error"])

    return src.mapInArrow(run, out).withColumnRenamed("_id", id_col)


def encode_bytes(df: DataFrame, id_col: str, data_col: str, unit: int = WIDTH, pad: int = 32) -> DataFrame:
    """id, n_bytes, media: the bytes of data_col, padded to a positive multiple of unit, as a GIF."""

    def work(values):
        raw = [x or b"" for x in values]
        return [len(x) for x in raw], [encode_gif(x + bytes([pad]) * (max(1, -(-len(x) // unit)) * unit - len(x)), unit) for x in raw]

    name = fresh(df, "_data")
    return map_texts(df.withColumn(name, F.col(data_col).cast("binary")), id_col, [name], "n_bytes long, media binary", lambda: work)


def describe(df: DataFrame, id_col: str) -> DataFrame:
    """Reads the media column back: digests of the shown samples and of the stored form, and features."""

    def one(n, media):
        whole, tail, size, frames, ms, total = sha256(), b"", 0, 0, 0, np.zeros(64, np.int64)
        for canvas, x, y, w, h, delay, _ in frames_of(media):
            shown = canvas[y : y + h, x : x + w]
            data = shown[..., 0].tobytes()
            whole.update(data)
            tail, size, frames, ms = (tail + data[-16:])[-16:], size + len(data), frames + 1, ms + delay
            total += histogram(shown)
        feature = f"frames={frames};ms={ms};colours=" + ",".join(f"{k}:{v}" for k, v in enumerate(total.tolist()) if v)
        return n, size, whole.hexdigest(), zlib.crc32(tail), len(media), sha256(media).hexdigest(), feature

    def work(n_bytes, media):
        return list(zip(*map(one, n_bytes, media), strict=True))

    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_texts(df, id_col, ["n_bytes", "media"], schema, lambda: work)


def op3_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return describe(encode_bytes(docs, "doc_id", "text"), "doc_id")
