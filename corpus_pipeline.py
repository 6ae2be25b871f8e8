"""A training corpus from documents: reject toxic ones, drop exact and near copies, mix sources, pack.

Each stage's result is written and read again as the next one's documents. A
stage's own tables live in one workspace, which the next stage removes first; no
other operator's tables are touched.

Defined cases, in every stage: null and empty texts, repeated rows, null ids and
sources, and texts of any length are handled as the stage's operator says; an
empty table gives no rows; columns other than doc_id, text and source are carried
through unchanged, whatever their names, up to packing, which gives pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirework.llm.exactdedup import drop_duplicates
from quirework.llm.mixing import mixed
from quirework.llm.neardedup import drop_near_duplicates
from quirework.llm.packing import pack_documents, with_crc32
from quirework.llm.queries import table, vocabulary
from quirework.llm.toxicity import accepted
from quirework.llm.workspace import Workspace


_last: list[Workspace] = []


def _workspace(spark: SparkSession) -> Workspace:
    """A workspace for one stage. The tables of the stage before, whose result has been written by now, go."""
    while _last:
        _last.pop().clear()
    _last.append(Workspace(spark))
    return _last[0]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject; all if there are no labels of both kinds."""
    return accepted(docs, table(spark, sf_dir, "labels"), work=_workspace(spark))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id."""
    return drop_duplicates(docs, work=_workspace(spark))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id."""
    return drop_near_duplicates(docs, work=_workspace(spark))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their source ask for."""
    return mixed(docs, work=_workspace(spark))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their place in sequences of 1024 tokens."""
    return with_crc32(pack_documents(docs, vocabulary("byte_bpe_50k.json"), window=1024, end_id=0, work=_workspace(spark)).drop("doc_row"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: The classifier chain, near duplicates and tokens can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    work = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = work.save(docs, name)
            if i:
                work.drop(STAGES[i - 1][0])
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
