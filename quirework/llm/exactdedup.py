"""Exact duplicates by sorting content.

Rows are dealt by sampled splitters on the first bytes of the normalised text,
a hash of all of it and the id, so copies of one text, however many, spread over
as many partitions as they fill. Each partition is sorted on disk by the whole
text; neighbours are then compared in full and form runs. A run that touches the
edge of its partition may go on in the next one: those (two a partition) are
joined by whole text, and the smallest id of all parts stays.

The number of partitions follows the bytes of the input, so a partition and what
a task keeps of it (some numbers and a digest a row) stay the same size.

Texts are equal when identical after each run of [\\x20\\x09-\\x0D] becomes one
space. Null texts count as empty, so empty and null texts are equal. Of rows
with the same smallest id and text all stay; a null id is larger than any
other. A text of any length is one row of the sort and is compared whole. An
empty table gives no rows; other columns are ignored here and untouched by
``drop_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.workspace import Workspace, partitions_for

#: Characters of the text in the splitters; they order most texts, the hash the rest.
PREFIX = 24
#: Rows of runs at the edges of partitions that are broadcast; more are joined by shuffling.
BROADCAST_EDGES = 200_000


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the runs of equal neighbours. Keeps one text, and a few numbers a row, until the partition ends."""
    part, run = TaskContext.get().partitionId(), -1
    last: pa.Scalar | None = None
    first_text = last_text = None
    ids, nones, shas, runs = [], [], [], []
    for batch in batches:
        if not len(batch):
            continue
        text = batch.column(2)
        new = np.ones(len(text), bool)
        new[1:] = ~np.asarray(pc.equal(text.slice(1), text.slice(0, len(text) - 1)))
        new[0] = last is None or last != text[0].as_py()
        number = run + np.cumsum(new)
        run = int(number[-1])
        last = text[len(text) - 1].as_py()
        first_text = text[0].as_py() if first_text is None else first_text
        last_text = last
        nones.append(np.asarray(batch.column(0).cast(pa.uint8())).astype(bool))
        ids.append(np.asarray(batch.column(1)))
        shas.append(batch.column(3))
        runs.append(number)
    if not ids:
        return
    none, id_, number = np.concatenate(nones), np.concatenate(ids), np.concatenate(runs)
    sizes = np.bincount(number)
    # the sort puts null ids last in a run, and the smallest id first
    head = np.flatnonzero(np.diff(number, prepend=-1))
    at = 0
    for sha in shas:
        n = len(sha)
        own = number[at : at + n]
        edge = np.where(own == 0, 0, np.where(own == run, 1, -1))
        texts = np.full(n, None, object)
        for i in head[(head >= at) & (head < at + n)] - at:
            if edge[i] >= 0:
                texts[i] = first_text if edge[i] == 0 else last_text
        least = pa.StructArray.from_arrays([pa.array(none[head[own]]), pa.array(id_[head[own]])], names=["none", "id"])
        yield pa.RecordBatch.from_arrays(
            [pa.array(none[at : at + n]), pa.array(id_[at : at + n]), sha, pa.array([part] * n, pa.int32()), pa.array(edge.astype(np.int32)), least, pa.array(sizes[own]), pa.array(texts, pa.string())],
            names=["none", "id", "text_sha256", "part", "edge", "run_least", "run_size", "edge_text"],
        )
        at += n


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, work: Workspace | None = None) -> DataFrame:
    """One row a document: id, keep_id, group_size, kept, text_sha256 of the normalised text. The id column is a long.

    partitions: by default one for each 128 MB of input, and at least the session's shuffle partitions.
    """
    work = work or Workspace(docs.sparkSession)
    partitions = partitions or partitions_for(docs)
    id_ = F.col(id_col).cast("bigint")
    rows = docs.select(id_.isNull().alias("none"), F.coalesce(id_, F.lit(0)).alias("id"), normalised(F.col(text_col)).alias("norm"))
    rows = rows.withColumn("text_sha256", F.sha2("norm", 256)).withColumn("head", F.substring("norm", 1, PREFIX)).withColumn("mark", F.xxhash64("norm"))
    # samples of the splitters hold the prefix and two numbers, not a digest
    dealt = rows.repartitionByRange(partitions, "head", "mark", "none", "id").sortWithinPartitions("head", "mark", "norm", "none", "id")
    schema = "none boolean, id bigint, text_sha256 string, part int, edge int, run_least struct<none: boolean, id: bigint>, run_size bigint, edge_text string"
    runs = work.save(dealt.select("none", "id", "norm", "text_sha256").mapInArrow(_runs, schema), "runs")

    edges = runs.where("edge_text IS NOT NULL").select("part", "edge", "run_least", "run_size", "text_sha256", "edge_text")
    groups = edges.groupBy("text_sha256", "edge_text").agg(F.min("run_least").alias("least"), F.sum("run_size").alias("size"))
    merged = work.save(edges.join(groups, ["text_sha256", "edge_text"]).select("part", "edge", "least", "size"), "merged")
    if merged.count() <= BROADCAST_EDGES:  # at most two rows a partition
        merged = F.broadcast(merged)
    out = runs.drop("edge_text").join(merged, ["part", "edge"], "left").withColumn("least", F.coalesce("least", "run_least"))
    same = (F.col("none") == F.col("least.none")) & (F.col("id") == F.col("least.id"))
    return out.select(F.when(~F.col("none"), F.col("id")).alias(id_col), F.when(~F.col("least.none"), F.col("least.id")).alias("keep_id"), F.coalesce("size", "run_size").alias("group_size"), same.alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", work: Workspace | None = None) -> DataFrame:
    """The rows of docs whose text no row with a smaller id has."""
    groups = exact_groups(docs, id_col=id_col, text_col=text_col, work=work)
    dropped = groups.where(~F.col("kept")).select(F.col(id_col).alias("__drop_id"), F.col("text_sha256").alias("__drop_sha")).distinct()
    same = docs[id_col].cast("bigint").eqNullSafe(F.col("__drop_id")) & (F.sha2(normalised(docs[text_col]), 256) == F.col("__drop_sha"))
    return docs.join(dropped, same, "left_anti")
