"""Image files and request bodies by hand-written cases."""

import struct
import zlib

import numpy as np
import pytest

from quirework.sources import images


def png(rows, wide, depth, kind, *, filters=None, laced=0, colours=b""):
    """A PNG of bytes per row."""
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", wide, len(rows), depth, kind, 0, 0, laced)
    raw = b"".join(bytes([f]) + bytes(r) for f, r in zip(filters or [0] * len(rows), rows, strict=True))
    packed = zlib.compress(raw)
    return bytes.fromhex(images.PNG) + chunk(b"IHDR", head) + (chunk(b"PLTE", colours) if colours else b"") + chunk(b"IDAT", packed[:5]) + chunk(b"IDAT", packed[5:]) + chunk(b"IEND", b"")


def filtered(rows, step, kind):
    """Rows as each filter stores them."""
    out, above = [], [0] * len(rows[0])
    for row in rows:
        line = []
        for i, x in enumerate(row):
            a, b, c = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            p = a + b - c
            likely = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((x - [0, a, b, (a + b) // 2, likely][kind]) % 256)
        out.append(line)
        above = row
    return out


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    image = np.random.default_rng(kind).integers(0, 256, (7, 5, 3))
    rows = image.reshape(7, 15).tolist()
    assert (images.png_pixels(png(filtered(rows, 3, kind), 5, 8, 2, filters=[kind] * 7)) == image[:, :, ::-1]).all()


def test_png_kinds():
    grey = images.png_pixels(png([[0b10110000]], 4, 1, 0))
    assert grey[0, :, 0].tolist() == [255, 0, 255, 255] and grey.shape == (1, 4, 3)
    assert images.png_pixels(png([[0x1F]], 2, 4, 0))[0, :, 1].tolist() == [17, 255]
    assert images.png_pixels(png([[9, 128, 8, 0]], 2, 8, 4))[0, :, 2].tolist() == [9, 8]
    assert images.png_pixels(png([[1, 2, 3, 255]], 1, 8, 6)).tolist() == [[[3, 2, 1]]]
    assert images.png_pixels(png([[7, 99]], 1, 16, 0)).tolist() == [[[7, 7, 7]]]
    assert images.png_pixels(png([[1, 0]], 2, 8, 3, colours=bytes([1, 2, 3, 4, 5, 6]))).tolist() == [[[6, 5, 4], [3, 2, 1]]]


def test_png_interlaced():
    image = np.arange(64).reshape(8, 8)
    raw = b""
    for x0, y0, dx, dy in images._PASSES:
        for row in image[y0::dy, x0::dx]:
            raw += b"\0" + bytes(row.tolist())
    body = png([[0] * 8] * 8, 8, 8, 0, laced=1)
    whole = zlib.compress(raw)
    chunk = struct.pack(">I", len(whole)) + b"IDAT" + whole + struct.pack(">I", zlib.crc32(b"IDAT" + whole))
    body = body[:33] + chunk + struct.pack(">I", 0) + b"IEND" + struct.pack(">I", zlib.crc32(b"IEND"))
    assert (images.png_pixels(body)[:, :, 0] == image).all()


@pytest.mark.parametrize("body", [b"", b"\x89PNG", png([[0]], 1, 8, 0)[:40], png([[0]], 20000, 8, 0), png([[0]], 1, 8, 0, filters=[9]), b"GIF89a" + b"0" * 40])
def test_what_is_no_png_gives_none(body):
    assert images.png_pixels(body) is None


def test_headers_that_are_cut_or_odd():
    assert images.jpeg_size(b"\xff\xd8\xff\xc4\x00\x03a\xff\xc2\x00\x11\x08\x00\x05\x00\x07\x03") == (7, 5)
    assert images.jpeg_size(b"\xff\xd8\x00\x00" + b"0" * 20) is None
    assert images.webp_size(b"RIFF\0\0\0\0WEBPVP8 " + b"\0" * 20) is None
    assert images.webp_size(b"RIFF") is None


def test_slots_are_gathered_in_their_order(spark):
    slots = spark.createDataFrame([(1, 2, "c", None), (1, 0, "a", None), (1, 1, None, "empty"), (2, None, None, None)], "id int, slot int, body string, error string")
    got = images.gathered_slots(slots, ["id"], "body").collect()
    assert [(r.id, r.results, r.errors) for r in got] == [(1, ["a", None, "c"], [None, "empty", None])]


def test_batches_that_are_too_large(spark):
    import base64

    big, small = (base64.b64encode(png([[0]], w, 8, 0)).decode() for w in (20000, 1))
    rows = spark.createDataFrame([(1, f'{{"images":["{small}","{big}"]}}')], "id int, body string")
    assert [(r.slot, r.error, r.code) for r in images.base64_slots(rows, "body").orderBy("slot").collect()] == [(0, None, None), (1, "dimensions_too_large (20000x1 > 16384x16384)", None)]
    assert {(r.slot, r.error, r.code) for r in images.base64_slots(rows, "body", strict=True).collect()} == {(0, None, "DIMENSIONS_TOO_LARGE"), (1, None, "DIMENSIONS_TOO_LARGE")}


def test_raw_bodies(spark):
    rows = spark.createDataFrame([(1, b""), (2, None), (3, b"x")], "id int, content binary")
    assert {(r.id, r.error) for r in images.raw_requests(rows).collect()} == {(1, "EMPTY_BODY"), (2, "EMPTY_BODY"), (3, None)}
