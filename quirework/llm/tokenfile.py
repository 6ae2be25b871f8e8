"""Token ids as Parquet list columns.

Documents are dealt by sampled splitters on (id, hash of the text, row), sorted,
tokenised in that order and written by Spark's own writer: one file for each
PARTITION bytes of input, int32 lists in dictionary or delta encoding, row groups and pages
of a set size, page indexes on. Rows keep the partition number and the number
of tokens that stand before them in the file, so the global position of a
document needs only one total a file.

Ids are written in ascending order, nulls first; rows with one id are ordered
by a hash of their text, and equal rows, however many, spread over as many files
as they fill. Null texts count as empty; a text of any length is one list; an
empty table writes an empty file set. Columns other than the two named are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.llm.bytetext import slices, text_array
from quirework.llm.encoding import encoder
from quirework.llm.workspace import partitions_for

#: Bytes of text whose words are looked up together.
TOGETHER = 3 << 20
SCHEMA = "doc_id {id}, part int, local_start bigint, n_tokens bigint, tokens array<int>"


def _tokenise(vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, start = encoder(vocabulary, "<i4"), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<i4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0), text_array(batch.column(1))
            for at, _, offsets in slices(texts, TOGETHER):
                tokens = [x + end for x in code.encode(texts[at : at + len(offsets) - 1].to_pylist())]
                counts = np.array([len(x) // 4 for x in tokens], np.int64)
                ends = np.cumsum(counts)
                values = pa.array(np.frombuffer(b"".join(tokens), np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), values)
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(tokens)), pa.array([part] * len(tokens), pa.int32()), pa.array(start + ends - counts), pa.array(counts), lists], names=["doc_id", "part", "local_start", "n_tokens", "tokens"])
                start += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text", files: int | None = None, encoding: str = "dictionary", row_group_mb: int = 32, page_kb: int = 256) -> None:
    """Writes the token files. files: their number; by default by the bytes of the input, the session's shuffle partitions at least.

    encoding: "dictionary", or "delta" for DELTA_BINARY_PACKED values.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding is dictionary or delta, not {encoding}")
    files = files or partitions_for(docs)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(files, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    schema = SCHEMA.format(id=docs.schema[id_col].dataType.simpleString())
    (
        dealt.mapInArrow(_tokenise(vocabulary, end_id), schema)
        .write.option("compression", "zstd")
        .option("parquet.block.size", row_group_mb << 20)
        .option("parquet.page.size", page_kb << 10)
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.writer.version", "PARQUET_1_0" if encoding == "dictionary" else "PARQUET_2_0")
        .parquet(path)
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, start, n_tokens of every document, without reading a token. start: tokens of all documents before it."""
    rows = spark.read.parquet(path).select("doc_id", "part", "local_start", "n_tokens")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # one row a file, so one task can order them
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, "part").select("doc_id", "part", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens")


def read_tokens(spark: SparkSession, path: str, first=None, last=None) -> DataFrame:
    """doc_id, tokens of the documents from id `first` to `last`; row groups and pages outside are skipped."""
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    return rows.select("doc_id", "tokens")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, local_start, n_tokens and ids_crc32 from the tokens as they were read back."""
    rows = spark.read.parquet(path).select("doc_id", "part", "local_start", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            at = np.asarray(lists.offsets)
            values = np.asarray(lists.values).astype("<u4", copy=False)
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, part int, local_start bigint, n_tokens bigint, ids_crc32 bigint")
