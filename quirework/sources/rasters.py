"""Portable pixmaps, label files, paths of models, and settings within bounds."""

from __future__ import annotations

import re
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Longest side of an image.
MOST = 16384
_HEADER = re.compile(rb"P([56])(?:\s+|\s*#[^\n]*\n)+(\d+)(?:\s+|\s*#[^\n]*\n)+(\d+)(?:\s+|\s*#[^\n]*\n)+(\d+)\s")


def ppm_pixels(body: bytes) -> np.ndarray | None:
    """height x width x 3 (blue, green, red) of a binary grey or colour pixmap with values to 255; None if it is none."""
    head = _HEADER.match(bytes(body[:4096]))
    if not head:
        return None
    kind, wide, high, top = (int(x) for x in head.groups())
    depth = 3 if kind == 6 else 1
    if top != 255 or not 0 < wide <= MOST or not 0 < high <= MOST or len(body) - head.end() < wide * high * depth:
        return None
    pixels = np.frombuffer(body, np.uint8, wide * high * depth, head.end()).reshape(high, wide, depth)
    return pixels[:, :, ::-1] if depth == 3 else np.repeat(pixels, 3, 2)


def read_labels(spark: SparkSession, path: str) -> list[str]:
    """The letters of a recogniser: a blank, the lines of the file in order, a space. A file has at most some ten thousand lines."""
    body = spark.read.format("binaryFile").load(path).select("content").first()[0].decode("utf-8")
    lines = body.split("\n")
    return ["blank", *(x.rstrip("\r") for x in (lines[:-1] if lines[-1] == "" else lines)), " "]


def model_paths(settings: Mapping[str, str], model_key: str = "REC_ONNX") -> tuple[str, str]:
    """(model, labels): each as set, else those of the language, else the plain ones; latin has the plain ones."""
    language = settings.get("OCR_LANG", "")
    model, labels = ("models/rec.onnx", "models/keys.txt") if language in ("", "latin") else (f"models/rec/{language}/rec.onnx", f"models/rec/{language}/dict.txt")
    return settings.get(model_key) or model, settings.get("REC_DICT") or labels


def bounded(text: str | None, default: int, least: int = 1, most: int = 65535) -> int:
    """A whole number within bounds; what is none gives the default."""
    return min(max(int(text), least), most) if text and re.fullmatch(r"[+-]?\d+", text.strip()) else default


def time_ordered_id() -> Column:
    """UUIDs of version 7: the query's time in milliseconds, then random."""
    tail, stamp = F.expr("uuid()"), F.lower(F.lpad(F.hex(F.unix_millis(F.current_timestamp())), 12, "0"))
    return F.concat(F.substring(stamp, 1, 8), F.lit("-"), F.substring(stamp, 9, 4), F.lit("-7"), F.substring(tail, 16, 21))


@F.pandas_udf(T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType()), T.StructField("total", T.LongType())]))
def ppm_summary(body: pd.Series) -> pd.DataFrame:
    images = [ppm_pixels(x) if x is not None else None for x in body]
    return pd.DataFrame([(x.shape[1], x.shape[0], int(x.sum())) if x is not None else (None,) * 3 for x in images], columns=["width", "height", "total"]).astype("Int64")


def _ppm_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixmaps made from document ids: sides doc_id % 7 and doc_id % 5 + 1, every value 65, colour or grey."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    wide, high, depth = F.col("doc_id") % 7, F.col("doc_id") % 5 + 1, F.when(F.col("doc_id") % 2 == 0, 3).otherwise(1)
    head = F.concat(F.when(depth == 3, F.lit("P6")).otherwise(F.lit("P5")), F.lit("\n# made\n"), wide.cast("string"), F.lit(" "), high.cast("string"), F.lit("\n255\n"))
    body = F.encode(F.concat(head, F.repeat(F.lit("A"), (wide * high * depth).cast("int"))), "utf-8")
    return docs.withColumn("image", ppm_summary(body)).select("doc_id", "image.width", "image.height", "image.total")


QUERIES = {"ppm_decode": _ppm_query}
ORACLES = {"ppm_decode": "SELECT doc_id, CASE WHEN w > 0 THEN w END AS width, CASE WHEN w > 0 THEN h END AS height, CASE WHEN w > 0 THEN w * h * 195 END AS total FROM (SELECT doc_id, doc_id % 7 AS w, doc_id % 5 + 1 AS h FROM documents)"}
