"""Media columns: GIF. Texts stored as 8-bit images, and a decoder that returns timed frames with colour histograms."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches, text_of

WIDTH = 192
#: Rows of a frame, at most: what is decoded at once.
FRAME_ROWS = 4096
DELAY_CS = 10
MAX_BITS = 12
HISTOGRAM_BINS = 8  # of 32 levels each
#: First row and step of an interlaced image's four passes (fixed values of the format).
PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))
GREYS = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
FRAME_TYPE = "array<struct<no:int,delay_ms:int,disposal:int,width:int,height:int,plane:binary,rgb:binary,histogram:array<int>>>"


# --- code streams ---------------------------------------------------------------------------------------------------


def code_widths(n: int, bits: int, first: int = 0) -> np.ndarray:
    """Widths of the codes first to first + n - 1 after a clear code: code i is read when (1 << bits) + 2 + max(0, i - 1)
    entries are known."""
    known = (1 << bits) + 2 + np.maximum(np.arange(first, first + n) - 1, 0)
    return np.clip(np.floor(np.log2(known)).astype(np.int64) + 1, bits + 1, MAX_BITS)


@lru_cache(maxsize=8)
def first_widths(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths and bit offsets of the first codes after a clear code, more than fill the table."""
    widths = code_widths((1 << MAX_BITS) + 100, bits)
    return widths, np.cumsum(widths) - widths


def pack_codes(runs: list[list[int]], bits: int) -> bytes:
    """Bytes of a clear code, the runs, which each end with a clear or the end code, least bits first."""
    known = first_widths(bits)[0]
    widths = np.concatenate([[bits + 1], *(known[: len(r)] for r in runs)])
    codes = np.array([1 << bits, *chain.from_iterable(runs)], dtype=np.int64)
    offsets = np.cumsum(widths) - widths
    shifted, byte = codes << (offsets & 7), offsets >> 3
    n = int(offsets[-1] + widths[-1] + 7) >> 3
    # codes share no bits, so sums of their bytes are the bytes
    total = sum(np.bincount(byte + k, weights=(shifted >> 8 * k) & 255, minlength=n + 3) for k in range(3))
    return total[:n].astype(np.uint8).tobytes()


def lzw_encode(samples: bytes, bits: int = 8) -> bytes:
    """Greedy codes from a table of (prefix code, sample); a clear code when the table is full. Codes are kept times 256, so that
    a code and a sample make a key by one or."""
    clear, end = 1 << bits, (1 << bits) + 1
    full = 1 << MAX_BITS + 8
    run: list[int] = []
    runs, table = [run], {}
    append, get, free = run.append, table.get, end + 1 << 8
    prefix = samples[0] << 8 if samples else 0
    for sample in samples[1:]:
        key = prefix | sample
        code = get(key)
        if code:
            prefix = code
            continue
        append(prefix)
        prefix = sample << 8
        if free < full:
            table[key] = free
            free += 256
        else:
            append(clear << 8)
            run = []
            runs.append(run)
            append = run.append
            table.clear()
            free = end + 1 << 8
    if samples:
        append(prefix)
    append(end << 8)
    return pack_codes([[code >> 8 for code in r] for r in runs], bits)


def _expand(codes: np.ndarray, bits: int) -> np.ndarray:
    """Samples of the codes between two clear codes.

    Entry k of the table is the string of code k with the sample after it, which stand side by side in the output. So each
    code is a literal or a copy of what begins where code k began, and both lengths and samples follow by pointer
    doubling, without a table and in as many steps as the logarithm of the longest chain.
    """
    codes = codes.astype(np.int32)
    places = np.arange(len(codes), dtype=np.int32)
    parent = codes - ((1 << bits) + 2)
    copied = parent >= 0
    if (parent >= places).any():
        raise ValueError("a code that isn't in the table yet")
    # a literal points to itself and adds nothing
    up, depth = np.where(copied, parent, places), copied.astype(np.int32)
    while (more := depth[up]).any():
        depth, up = depth + more, up[up]
    length = depth + 1
    begin = np.cumsum(length, dtype=np.int32) - length
    back = np.where(copied, begin[np.maximum(parent, 0)] - begin, 0)
    at = np.repeat(places, length)
    source = np.arange(len(at), dtype=np.int32) + back[at]
    while True:
        further = source[source]
        if np.array_equal(further, source):
            return codes.astype(np.uint8)[at[source]]
        source = further


def lzw_decode(data: bytes, bits: int) -> bytes:
    """Samples of a code stream; it may end without its end code."""
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8).astype(np.int32)
    words = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    total, bit, out = len(data) * 8, 0, []
    while bit < total:
        parts, done = [], 0
        widths, offsets = first_widths(bits)
        while True:  # codes up to the next clear or end code
            offsets = bit + offsets
            fits = int(np.searchsorted(offsets + widths, total, side="right"))
            part, used = offsets[:fits], widths[:fits]
            codes = words[part >> 3] >> (part & 7) & (1 << used) - 1
            stops = np.flatnonzero(codes >> 1 == clear >> 1)
            if len(stops) or fits < len(offsets):
                break
            parts.append(codes)
            bit, done = int(part[-1] + used[-1]), done + len(codes)
            widths = code_widths(2 * len(codes), bits, done)
            offsets = np.cumsum(widths) - widths
        stop = int(stops[0]) if len(stops) else len(codes)
        segment = np.concatenate([*parts, codes[:stop]])
        if len(segment):
            out.append(_expand(segment, bits))
        if not len(stops) or codes[stop] == end:
            break
        bit = int(part[stop] + used[stop])
    return b"".join(x.tobytes() for x in out)


# --- files ----------------------------------------------------------------------------------------------------------


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode_gif(payload: bytes) -> bytes:
    """A grey image WIDTH samples wide, as an animation of frames of FRAME_ROWS rows; payload: whole rows."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, FRAME_ROWS), 0xF7, 0, 0), GREYS]
    for first in range(0, rows, FRAME_ROWS):
        samples = payload[first * WIDTH : (first + FRAME_ROWS) * WIDTH]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, DELAY_CS, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(samples) // WIDTH, 0) + b"\x08")
        out.append(_blocks(lzw_encode(samples)))
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    """A composed frame. plane: the first colour channel of the frame's own rectangle; rgb: the whole canvas, if asked for."""

    no: int
    delay_ms: int
    disposal: int
    width: int
    height: int
    plane: bytes
    rgb: bytes | None
    histogram: list[int]


def decode_gif(data: bytes, with_rgb: bool = True) -> Iterator[Frame]:
    """Frames in order: codes decoded, palette applied, composed by the disposal and transparency rules.

    Disposal 2 clears a frame's rectangle after it was shown, 3 restores what was there before, others leave it. The
    histogram counts the canvas's drawn pixels in HISTOGRAM_BINS bins for each channel. Pixels that a code stream lacks
    stay as they are; codes beyond the rectangle are ignored.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, no = 13, 0
    shared = None
    if flags & 0x80:
        shared, at = np.frombuffer(data, np.uint8, 3 << (flags & 7) + 1, at).reshape(-1, 3), at + (3 << (flags & 7) + 1)
    canvas = np.zeros((height, width, 4), dtype=np.uint8)
    delay = disposal = 0
    clear = None

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        return b"".join(parts), at + 1

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            body, after = blocks(at + 2)
            if data[at + 1] == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear = packed >> 2 & 7, index if packed & 1 else None
            at = after
            continue
        x, y, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at, palette = at + 10, shared
        if flags & 0x80:
            palette, at = np.frombuffer(data, np.uint8, 3 << (flags & 7) + 1, at).reshape(-1, 3), at + (3 << (flags & 7) + 1)
        bits = data[at]
        body, at = blocks(at + 1)
        found = np.frombuffer(lzw_decode(body, bits), np.uint8)[: w * h]
        samples, given = np.zeros(w * h, np.uint8), np.zeros(w * h, bool)
        samples[: len(found)], given[: len(found)] = found, True
        samples, given = samples.reshape(h, w), given.reshape(h, w)
        if flags & 0x40:
            rows = np.concatenate([np.arange(first, h, step) for first, step in PASSES])
            ordered, there = np.empty_like(samples), np.empty_like(given)
            ordered[rows], there[rows] = samples, given
            samples, given = ordered, there
        w, h = max(0, min(w, width - x)), max(0, min(h, height - y))
        samples, given = samples[:h, :w], given[:h, :w]
        if clear is not None:
            given = given & (samples != clear)
        everywhere = bool(given.all())
        if palette is None or (samples.size and int(samples.max() if everywhere else np.where(given, samples, 0).max()) >= len(palette)):
            raise ValueError("a colour that isn't in the palette")
        area = canvas[y : y + h, x : x + w]
        before = area.copy() if disposal == 3 else None
        if everywhere:
            area[..., :3], area[..., 3] = palette[samples], 255
        else:
            area[given, :3], area[given, 3] = palette[samples[given]], 255
        if everywhere and (h, w) == (height, width):  # the canvas is this frame: count its colours' numbers
            times, levels = np.bincount(samples.ravel(), minlength=len(palette)), palette >> 5
            counts = [int(n) for c in range(3) for n in np.bincount(levels[:, c], weights=times, minlength=HISTOGRAM_BINS)]
        else:
            drawn = canvas[canvas[..., 3] > 0][:, :3] >> 5
            counts = [int(n) for c in range(3) for n in np.bincount(drawn[:, c], minlength=HISTOGRAM_BINS)]
        yield Frame(no, delay * 10, disposal, w, h, area[..., 0].tobytes(), canvas[..., :3].tobytes() if with_rgb else None, counts)
        if disposal == 2:
            area[:] = 0
        elif disposal == 3:
            area[:] = before
        no, delay, disposal, clear = no + 1, 0, 0, None


# --- columns --------------------------------------------------------------------------------------------------------


def _frames(file: bytes | None, with_rgb: bool) -> list[dict]:
    return [vars(f) for f in decode_gif(bytes(file), with_rgb)] if file else []


def _stored(text: str) -> bytes:
    raw = text.encode("utf-8")
    return encode_gif(raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b" "))


def decode_media(media: DataFrame, column: str = "media", with_rgb: bool = True) -> DataFrame:
    """media with frames, an array of its GIFs' composed frames. Null or empty bytes: no frames. Bytes that aren't a GIF are an error.
    Other columns stay; one that is named frames already becomes frames_before. Repeated rows stay; an empty table gives no rows."""
    if "frames" in media.columns and column != "frames":
        media = media.withColumnRenamed("frames", "frames_before")

    @F.pandas_udf(FRAME_TYPE)
    def frames(files: pd.Series) -> pd.Series:
        return pd.Series([_frames(x, with_rgb) for x in files])

    return media.withColumn("frames", frames(column))


def media_columns(docs: DataFrame, with_rgb: bool = False) -> DataFrame:
    """Stores each text as a GIF and reads it back: (doc_id, n_bytes, media, frames), a row for each row of docs; no row is
    shuffled.

    The payload is the text's UTF-8 bytes and spaces up to a positive multiple of WIDTH; each byte is the index of a grey.
    frames are decoded from the stored bytes. Null text: empty, so one row of spaces. Null doc_id stays null. Equal texts give equal
    files, and each repeated row its own. Empty table: no rows. Extra columns are left out. Texts of any length are coded a
    frame at a time.
    """

    # one function for both: two would code each text twice, once for each column that needs the file
    @F.pandas_udf(f"media binary, frames {FRAME_TYPE}")
    def store(texts: pd.Series) -> pd.DataFrame:
        files = [_stored(t) for t in texts]
        return pd.DataFrame({"media": files, "frames": [_frames(x, with_rgb) for x in files]})

    text_batches(docs.sparkSession)
    rows = docs.select("doc_id", text_of().alias("text"))
    stored = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), store("text").alias("stored"))
    return stored.select("doc_id", "n_bytes", "stored.media", "stored.frames")
