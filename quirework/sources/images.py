"""Image headers, PNG pixels, and encoded request bodies with the error of each that can't be read.

Bodies that can't be parsed give a row with their error, never none: the codes
are tested in the order in which a server would meet them.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The first bytes of a PNG file.
PNG = "89504E470D0A1A0A"
#: A JPEG frame header may lie this far into the file.
SCANNED = 64 << 10
#: Longest side of an image.
MOST = 16384


def png_size(body: Column) -> tuple[Column, Column]:
    """(width, height) of a PNG by its header; null if it is none or a side is 0 or over 2**31 - 1."""
    side = lambda at: F.conv(F.hex(F.substring(body, at, 4)), 16, 10).cast("bigint")
    header = (F.length(body) >= 24) & (F.hex(F.substring(body, 1, 8)) == PNG) & (F.substring(body, 13, 4) == F.lit(b"IHDR"))
    good = header & side(17).between(1, 2**31 - 1) & side(21).between(1, 2**31 - 1)
    return F.when(good, side(17)), F.when(good, side(21))


def jpeg_size(body: bytes) -> tuple[int, int] | None:
    """(width, height) in the first start-of-frame segment."""
    if body[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= min(len(body), SCANNED):
        if body[at] != 0xFF:
            return None
        marker = body[at + 1]
        if marker == 0xFF:  # fill
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD8:  # without a length
            at += 2
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            high, wide = struct.unpack(">HH", body[at + 5 : at + 9])
            return (wide, high) if wide and high else None
        else:
            at += 2 + int.from_bytes(body[at + 2 : at + 4], "big")
    return None


def webp_size(body: bytes) -> tuple[int, int] | None:
    """(width, height) of the three kinds of WebP."""
    if body[:4] != b"RIFF" or body[8:12] != b"WEBP" or len(body) < 30:
        return None
    kind = body[12:16]
    if kind == b"VP8X":
        return int.from_bytes(body[24:27], "little") + 1, int.from_bytes(body[27:30], "little") + 1
    if kind == b"VP8L" and body[20] == 0x2F:
        bits = int.from_bytes(body[21:25], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8 " and body[23:26] == b"\x9d\x01\x2a":
        wide, high = struct.unpack("<HH", body[26:30])
        return (wide & 0x3FFF, high & 0x3FFF) if wide & 0x3FFF and high & 0x3FFF else None
    return None


@F.pandas_udf(T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())]))
def other_size(body: pd.Series) -> pd.DataFrame:
    found = [(jpeg_size(x) or webp_size(x) or (None, None)) if x is not None else (None, None) for x in body]
    return pd.DataFrame(found, columns=["width", "height"]).astype("Int64")


def with_size(df: DataFrame, body: str) -> DataFrame:
    """df with width and height of the image in a binary column: PNG, then JPEG, then WebP."""
    width, height = png_size(F.col(body))
    other = other_size(F.when(width.isNull(), F.col(body)))
    return df.withColumn("__other", other).withColumn("width", F.coalesce(width, "__other.width")).withColumn("height", F.coalesce(height, "__other.height")).drop("__other")


def read_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files of a folder as path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


# Channels of each PNG colour type, and where each pass of an interlaced image starts and how far it steps (x, y).
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def _unfiltered(data: bytes, rows: int, stride: int, step: int) -> np.ndarray:
    """Bytes of an image's rows, each of which adds to its left, upper, mean or likeliest neighbour."""
    lines = np.frombuffer(data, np.uint8, rows * (stride + 1)).reshape(rows, stride + 1)
    out = np.zeros((rows + 1, stride + step), np.uint8)
    for y in range(rows):
        kind, line, above = int(lines[y, 0]), lines[y, 1:], out[y]
        own = out[y + 1]
        if kind == 0:
            own[step:] = line
        elif kind == 1:
            own[step:] = np.concatenate([np.cumsum(line[c::step], dtype=np.uint8)[:, None] for c in range(step)], 1).ravel()[:stride] if stride % step == 0 else 0
        elif kind == 2:
            own[step:] = line + above[step:]
        elif kind in (3, 4):
            left, up, corner, here = own.tolist(), above.tolist(), above.tolist(), line.tolist()
            for i in range(stride):
                a, b = left[i], up[i + step]
                if kind == 3:
                    add = (a + b) // 2
                else:
                    c = corner[i]
                    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    add = a if da <= db and da <= dc else b if db <= dc else c
                left[i + step] = (here[i] + add) & 255
            own[:] = left
        else:
            raise ValueError(f"no such filter: {kind}")
    return out[1:, step:]


def png_pixels(body: bytes) -> np.ndarray | None:
    """height x width x 3 (blue, green, red) of a PNG of any kind, 16 bits cut to 8, transparency dropped; None if it is none or a side is over MOST."""
    try:
        if bytes(body[:8]) != bytes.fromhex(PNG):
            return None
        at, head, colours, packed = 8, None, None, b""
        while at + 8 <= len(body):
            size, kind = struct.unpack(">I4s", body[at : at + 8])
            data = bytes(body[at + 8 : at + 8 + size])
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", data)
            elif kind == b"PLTE":
                colours = np.frombuffer(data, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                packed += data
            elif kind == b"IEND":
                break
            at += 12 + size
        wide, high, depth, kind, _, _, laced = head
        if not 0 < wide <= MOST or not 0 < high <= MOST or kind not in _CHANNELS:
            return None
        n, raw, at = _CHANNELS[kind], zlib.decompress(packed), 0
        out = np.zeros((high, wide, n), np.uint8)
        for x0, y0, dx, dy in _PASSES if laced else [(0, 0, 1, 1)]:
            w, h = -(-(wide - x0) // dx), -(-(high - y0) // dy)
            if w <= 0 or h <= 0:
                continue
            stride = (w * n * depth + 7) // 8
            rows = _unfiltered(raw[at : at + h * (stride + 1)], h, stride, max(1, n * depth // 8))
            at += h * (stride + 1)
            if depth == 16:
                rows = rows[:, ::2]
            elif depth < 8:
                bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)[:, : w * n]
                rows = bits @ (1 << np.arange(depth)[::-1]).astype(np.uint8)
                rows = rows if kind == 3 else rows * np.uint8(255 // ((1 << depth) - 1))
            out[y0::dy, x0::dx] = rows.reshape(h, w, n)
        if kind == 3:
            return np.ascontiguousarray(colours[out[:, :, 0]][:, :, ::-1])
        return np.repeat(out[:, :, :1], 3, 2) if n < 3 else np.ascontiguousarray(out[:, :, 2::-1])
    except (ValueError, TypeError, struct.error, zlib.error, IndexError):
        return None


def _field(parsed: Column, name: str) -> Column:
    """A string field of a parsed body; null if it is missing or of another type."""
    value = F.try_variant_get(parsed, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(parsed, f"$.{name}", "string"))


def image_requests(requests: DataFrame, column: str, field: str = "image") -> DataFrame:
    """JSON bodies {field: base64} -> image and the code of the first error: INVALID_JSON, MISSING_IMAGE (or MISSING_PDF for field "pdf"), BASE64_DECODE_FAILED."""
    out = requests.withColumn("__parsed", F.try_parse_json(column)).withColumn("__text", _field(F.col("__parsed"), field))
    image = F.try_to_binary("__text", F.lit("base64"))
    out = out.withColumn("image", F.when(F.length(image) > 0, image))
    missing = F.col("__text").isNull() | (F.col("__text") == "")
    error = F.when(F.col("__parsed").isNull(), "INVALID_JSON").when(missing, f"MISSING_{field.upper()}").when(F.col("image").isNull(), "BASE64_DECODE_FAILED")
    return out.withColumn("error", error).drop("__parsed", "__text", column)


def raw_requests(files: DataFrame, column: str = "content") -> DataFrame:
    """Raw bodies with EMPTY_BODY where there is nothing."""
    return files.withColumn("error", F.when(F.coalesce(F.length(column), F.lit(0)) == 0, "EMPTY_BODY"))


def base64_slots(requests: DataFrame, column: str, *, most: int = MOST, strict: bool = False) -> DataFrame:
    """JSON bodies {"images": [base64, ...]} -> one row a slot: slot, image, error of the slot, code of the request.

    A body that can't be parsed or has no images is one row with slot null and
    the code INVALID_JSON or EMPTY_BATCH. Slots: "empty", "base64_decode_failed"
    or "dimensions_too_large (w x h > most)". strict: a slot that is too large
    fails the whole request (DIMENSIONS_TOO_LARGE), as does a request none of
    whose images can be read (IMAGE_DECODE_FAILED); other slots that can't be
    read are just empty.
    """
    images = F.from_json(column, "images array<string>")["images"]
    parsed = F.try_parse_json(column)
    own = [c for c in requests.columns if c != column]
    code = F.when(parsed.isNull(), "INVALID_JSON").when(F.coalesce(F.size(images), F.lit(0)) <= 0, "EMPTY_BATCH")
    out = requests.withColumn("__images", images).withColumn("code", code).withColumn("__row", F.monotonically_increasing_id())
    out = out.select(*own, "__row", "code", F.posexplode_outer(F.when(F.col("code").isNull(), F.col("__images"))).alias("slot", "__encoded"))
    image = F.try_to_binary("__encoded", F.lit("base64"))
    out = with_size(out.withColumn("image", F.when(F.length(image) > 0, image)), "image")
    large = (F.col("width") > most) | (F.col("height") > most)
    size = F.format_string(f"dimensions_too_large (%dx%d > {most}x{most})", "width", "height")
    error = F.when(F.coalesce("__encoded", F.lit("")) == "", "empty").when(F.col("image").isNull(), "base64_decode_failed").when(large, size)
    out = out.withColumn("error", F.when(F.col("slot").isNotNull(), error))
    if strict:  # a request has as many slots as its body holds, so it is one small group
        whole = Window.partitionBy("__row")
        out = out.withColumn("code", F.coalesce("code", F.when(F.max(F.coalesce(large, F.lit(False))).over(whole), "DIMENSIONS_TOO_LARGE").when(F.count("image").over(whole) == 0, "IMAGE_DECODE_FAILED")))
        out = out.withColumn("error", F.lit(None).cast("string"))
    return out.select(*own, "slot", "image", "error", "code")


def gathered_slots(slots: DataFrame, keys: list[str], result: str) -> DataFrame:
    """Slots with a result (null where there is an error) -> for each request: results and errors, both in the order of the slots."""
    both = F.array_sort(F.collect_list(F.struct("slot", F.col(result).alias("result"), "error")))
    out = slots.where("slot IS NOT NULL").groupBy(*keys).agg(both.alias("__slots"))
    return out.select(*keys, F.col("__slots.result").alias("results"), F.col("__slots.error").alias("errors"))


def utf16le_text(column: Column) -> Column:
    """Text of UTF-16 bytes, low byte first."""
    return F.decode(column, "UTF-16LE")


def _png_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers made from the pages: width doc_id * 7 % 20000, height doc_id * 3 + 1; every fifth is no PNG."""
    side = lambda c: F.lpad(F.hex(c), 8, "0")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    mark = F.when(F.col("doc_id") % 5 == 0, F.lit("00504E470D0A1A0A")).otherwise(PNG)
    body = F.unhex(F.concat(mark, F.lit("0000000D49484452"), side(F.col("doc_id") * 7 % 20000), side(F.col("doc_id") * 3 + 1)))
    width, height = png_size(F.col("body"))
    return docs.withColumn("body", body).select("doc_id", width.alias("width"), height.alias("height"))


def _encoded(text: Column) -> Column:
    return F.base64(F.encode(text, "utf-8"))


def _base64_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies made from the documents' ids: three slots (good, bad, good), no JSON, no images, an empty slot; strict on every second."""
    number = F.col("doc_id").cast("string")
    three = F.concat(F.lit('{"images":["'), _encoded(F.lit("page")), F.lit('","!'), number, F.lit('","'), _encoded(number), F.lit('"]}'))
    kind = F.col("doc_id") % 5
    body = F.when(kind == 0, F.concat(F.lit('{"images":["'), number)).when(kind == 1, F.lit('{"images":[]}')).when(kind == 2, F.lit('{"images":[null,""]}')).otherwise(three)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", body.alias("body"))
    parts = [base64_slots(docs.where(F.col("doc_id") % 2 == k), "body", strict=bool(k)) for k in (0, 1)]
    return parts[0].unionByName(parts[1]).select("doc_id", "slot", F.decode("image", "utf-8").alias("content"), "error", "code")


def _image_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 6
    good = F.concat(F.lit('{"image":"'), _encoded(number), F.lit('"}'))
    body = F.when(kind == 0, "{").when(kind == 1, "{}").when(kind == 2, '{"image":7}').when(kind == 3, '{"image":""}').when(kind == 4, '{"image":"!!!!"}').otherwise(good)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", body.alias("body"))
    return image_requests(docs, "body").select("doc_id", F.decode("image", "utf-8").alias("content"), "error")


def _little(value: Column, size: int) -> Column:
    """Hexadecimal digits of a whole number, low byte first."""
    return F.concat(*[F.lpad(F.hex(F.shiftright(value.cast("bigint"), 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(size)])


def _sniff_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of every kind made from the documents' ids: PNG, JPEG, three kinds of WebP, and none."""
    wide, high, kind = F.col("doc_id") * 7 % 4000 + 1, F.col("doc_id") * 3 % 3000 + 1, F.col("doc_id") % 6
    big = lambda v, n: F.lpad(F.hex(v), 2 * n, "0")
    riff = F.lit("524946460000000057454250")
    body = (
        F.when(kind == 0, F.concat(F.lit(PNG + "0000000D49484452"), big(wide, 4), big(high, 4)))
        .when(kind == 1, F.concat(F.lit("FFD8FFE000046162FFFFC0001108"), big(high, 2), big(wide, 2), F.lit("03")))
        .when(kind == 2, F.concat(riff, F.lit("565038580A00000000000000"), _little(wide - 1, 3), _little(high - 1, 3)))
        .when(kind == 3, F.concat(riff, F.lit("5650384C000000002F"), _little((wide - 1).bitwiseOR(F.shiftleft((high - 1).cast("bigint"), 14)), 4), F.lit("0000000000")))
        .when(kind == 4, F.concat(riff, F.lit("56503820000000000000009D012A"), _little(wide, 2), _little(high, 2)))
        .otherwise(F.lit("0102030405060708090A0B0C0D0E0F101112131415161718191A1B1C1D1E1F"))
    )
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.unhex(body).alias("body"))
    return with_size(docs, "body").select("doc_id", "width", "height")


def _utf16_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", utf16le_text(F.encode(F.concat("text", F.lit("\U0001f600")), "UTF-16LE")).alias("text"))


QUERIES = {"png_dims": _png_query, "sniffed_dims": _sniff_query, "image_requests": _image_query, "base64_slots": _base64_query, "utf16_text": _utf16_query}
ORACLES = {
    "png_dims": "SELECT doc_id, CASE WHEN doc_id % 5 <> 0 AND doc_id * 7 % 20000 > 0 THEN doc_id * 7 % 20000 END AS width, CASE WHEN doc_id % 5 <> 0 AND doc_id * 7 % 20000 > 0 THEN doc_id * 3 + 1 END AS height FROM documents",
    "sniffed_dims": "SELECT doc_id, CASE WHEN doc_id % 6 < 5 THEN doc_id * 7 % 4000 + 1 END AS width, CASE WHEN doc_id % 6 < 5 THEN doc_id * 3 % 3000 + 1 END AS height FROM documents",
    "image_requests": """
        SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN doc_id::VARCHAR END AS content,
               CASE doc_id % 6 WHEN 0 THEN 'INVALID_JSON' WHEN 1 THEN 'MISSING_IMAGE' WHEN 2 THEN 'MISSING_IMAGE' WHEN 3 THEN 'MISSING_IMAGE' WHEN 4 THEN 'BASE64_DECODE_FAILED' END AS error FROM documents""",
    "base64_slots": """
        SELECT doc_id, CASE WHEN doc_id % 5 >= 2 THEN s.slot END AS slot, CASE WHEN doc_id % 5 > 2 THEN CASE s.slot WHEN 0 THEN 'page' WHEN 2 THEN doc_id::VARCHAR END END AS content,
               CASE WHEN doc_id % 2 = 1 THEN NULL WHEN doc_id % 5 = 2 THEN 'empty' WHEN doc_id % 5 > 2 AND s.slot = 1 THEN 'base64_decode_failed' END AS error,
               CASE WHEN doc_id % 5 = 0 THEN 'INVALID_JSON' WHEN doc_id % 5 = 1 THEN 'EMPTY_BATCH' WHEN doc_id % 5 = 2 AND doc_id % 2 = 1 THEN 'IMAGE_DECODE_FAILED' END AS code
        FROM documents, (VALUES (0), (1), (2)) AS s(slot) WHERE s.slot < CASE WHEN doc_id % 5 < 2 THEN 1 WHEN doc_id % 5 = 2 THEN 2 ELSE 3 END""",
    "utf16_text": "SELECT doc_id, text || '\U0001f600' AS text FROM documents",
}
