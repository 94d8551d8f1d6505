import hashlib
import zlib

import numpy as np
import pytest

from galegrid.llm import media, queries
from galegrid.llm.common import read_documents


def payload_of(text):
    raw = (text or "").encode()
    return raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")


def test_payloads_come_back(spark, sf_dir):
    texts = {r.doc_id: r.text for r in read_documents(spark, sf_dir).collect()}
    rows = queries.op10_gif_media(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        p = payload_of(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len((texts[r.doc_id] or "").encode()), len(p), hashlib.sha256(p).hexdigest())
        assert r.tail_crc32 == zlib.crc32(p[-16:])


def test_odd_rows(odd, none):
    rows = media.media_columns(odd).collect()
    assert len(rows) == odd.count() and media.media_columns(none).collect() == []
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in rows:
        if r.doc_id is not None:
            assert b"".join(f.plane for f in r.frames) == payload_of(texts[r.doc_id])


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_code_streams(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 2, 5000, 60_000):
        for data in (rng.integers(0, 1 << bits, n, dtype=np.uint8).tobytes(), bytes(n), (rng.integers(0, 2, n) * 3 % (1 << bits)).astype(np.uint8).tobytes()):
            assert media.lzw_decode(media.lzw_encode(data, bits), bits) == data


def slow_decode(data, bits):
    """The table-driven decoder of the format's description."""
    clear, out, at, width = 1 << bits, bytearray(), 0, bits + 1
    table, last = [bytes([i]) for i in range(clear)] + [b"", b""], None
    while at + width <= len(data) * 8:
        code = int.from_bytes(data[at // 8 : at // 8 + 3], "little") >> at % 8 & (1 << width) - 1
        at += width
        if code == clear:
            table, last, width = table[: clear + 2], None, bits + 1
            continue
        if code == clear + 1:
            break
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last is not None and len(table) < 4096:
            table.append(last + entry[:1])
            width = min(12, max(width, len(table).bit_length()))
        last = entry
    return bytes(out)


def test_decoder_agrees_with_a_table():
    rng = np.random.default_rng(0)
    data = (rng.integers(0, 9, 30_000) ** 2).astype(np.uint8).tobytes()
    assert slow_decode(media.lzw_encode(data), 8) == data


def animation(disposals, clear, interlaced=False):
    """Three 2 x 2 frames on a 4 x 4 canvas, at (0, 0), (1, 1) and (2, 2), in colours 1, 2 and 3."""
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    out = b"GIF89a" + (4).to_bytes(2, "little") * 2 + b"\x81\0\0" + palette
    for i, d in enumerate(disposals):
        out += b"\x21\xf9\x04" + bytes([d << 2 | 1, 5 * (i + 1), 0, clear]) + b"\0"
        out += b"\x2c" + b"".join(x.to_bytes(2, "little") for x in (i, i, 2, 2)) + bytes([0x40 if interlaced else 0, 2])
        out += media._blocks(media.lzw_encode(bytes([i + 1, i + 1, i + 1, 0]), 2))
    return out + b"\x3b"


def test_disposal_transparency_and_time():
    red, green, blue = (255, 0, 0), (0, 255, 0), (0, 0, 255)

    def pixel(frame, y, x):
        return tuple(frame.rgb[(y * 4 + x) * 3 :][:3])

    kept = list(media.decode_gif(animation([1, 1, 1], clear=0)))
    assert [f.delay_ms for f in kept] == [50, 100, 150]
    assert pixel(kept[1], 0, 0) == red and pixel(kept[1], 1, 1) == green and pixel(kept[2], 2, 2) == blue
    assert sum(kept[0].histogram[:8]) == 3  # colour 0 is transparent and wasn't drawn
    cleared = list(media.decode_gif(animation([2, 2, 2], clear=0)))
    assert pixel(cleared[1], 0, 0) == (0, 0, 0) and sum(cleared[1].histogram[:8]) == 3
    restored = list(media.decode_gif(animation([1, 3, 1], clear=0)))
    assert pixel(restored[2], 0, 0) == red and pixel(restored[2], 1, 2) == (0, 0, 0)
    crossed = list(media.decode_gif(animation([1, 1, 1], clear=0, interlaced=True)))
    assert pixel(crossed[0], 0, 1) == red


def test_stored_forms_and_features(spark, sf_dir):
    """The query's columns from the payload by plain Python: the stored file decodes, by a table, to the payload."""
    from galegrid.llm import queries

    texts = {r.doc_id: r.text for r in read_documents(spark, sf_dir).where("doc_id < 60").collect()}
    stored = {r.doc_id: bytes(r.media) for r in media.media_columns(read_documents(spark, sf_dir).where("doc_id < 60")).select("doc_id", "media").collect()}
    rows = [r for r in queries.op10_gif_media(spark, sf_dir).collect() if r.doc_id in texts]
    assert len(rows) == 60
    for r in rows:
        p, file = payload_of(texts[r.doc_id]), stored[r.doc_id]
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
        at, planes = 13 + 768, []
        while file[at] != 0x3B:
            assert file[at : at + 3] == b"\x21\xf9\x04" and file[at + 8] == 0x2C and file[at + 18] == 8
            at, parts = at + 19, []
            while n := file[at]:
                parts.append(file[at + 1 : at + 1 + n])
                at += n + 1
            at += 1
            planes.append(slow_decode(b"".join(parts), 8))
        assert b"".join(planes) == p
        levels = [0] * 8
        for b in p:
            levels[b >> 5] += 1
        assert r.feature == f"frames={len(planes)};ms={100 * len(planes)};levels={'-'.join(map(str, levels))}"
