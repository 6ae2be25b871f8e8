"""Mixing sources to target weights by repeating documents.

Sizes are summed by source; each source's share of all sizes follows its
weight, with at most ``most`` repeats of any source, the excess being shared
out again. A document comes floor(rate) times, and once more if its luck is
below the fraction of the rate: luck is a hash of the seed, its id and its text,
read as a number in [0, 1), plus the source's shift modulo 1. Of SHIFTS such
shifts a source has the one whose words come nearest to its target, so a small
source isn't left to one draw; each document's chance stays the fraction. The
hash doesn't depend on partitions, so reruns agree.

Texts are read twice: for sizes and luck, which are written as a narrow table,
and for the result. Totals are a written table of one row a source; it is
broadcast when it has at most BROADCAST_SOURCES rows and joined by shuffling
beyond. The level that sources share is found in one task, over one row of some
numbers a source.

Defined cases: null texts have size 0; a null source is a source of its own,
last in order; rows with the same id and text are taken alike, rows with one id
(or none) and different texts each by their own luck; a text of any length is
counted whole; an empty table gives no rows. Columns of the documents named like
an output column give way in ``mix`` and stay in ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm.workspace import Workspace

#: Hex digits of the hash that make the number in [0, 1), and numbers there are.
_DIGITS = 13
_RANGE = 16**_DIGITS
SHIFTS = 32
BROADCAST_SOURCES = 100_000
_ADDED = ("size", "source_size", "target", "copies")


def word_count(text) -> F.Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text: the places where one begins."""
    padded = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(padded, " +"), "")).cast("bigint")


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size -> also target. One row a source; the share level is found in closed form.

    Sources in order of most * size / weight: those that reach their limit come
    first, and the rest share what is left by weight.
    """
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    rows = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("limit", F.col("source_size") * F.lit(most)).withColumn("level", F.col("limit") / F.col("weight"))
    everything = Window.partitionBy()
    ranked = Window.orderBy("level", F.col("source").cast("binary").asc_nulls_last())
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("paid", F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("claims", F.sum("weight").over(ranked.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("share", (F.col("total") - F.col("paid")) / F.col("claims"))
    )
    # the first source in this order whose limit isn't reached sets the level for all after it
    level = F.min(F.when(F.col("level") > F.col("share"), F.struct("level", "share"))).over(everything)
    rows = rows.withColumn("found", level)
    target = F.when(F.col("found").isNull() | (F.col("level") < F.col("found.level")), F.col("limit").cast("double")).otherwise(F.col("weight") * F.col("found.share"))
    return rows.select("source", "source_size", target.alias("target"))


def _rate() -> F.Column:
    return F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(0.0)


def _again(shift) -> F.Column:
    """Does the row come once more under a source's shift?"""
    luck = ((F.col("__draw") + shift * (_RANGE // SHIFTS)) % _RANGE) / F.lit(float(_RANGE))
    return luck < F.col("__rate") - F.floor("__rate")


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], most: int, seed: str, work: Workspace | None) -> DataFrame:
    """docs with __size, __source_size, __target, __copies."""
    work = work or Workspace(docs.sparkSession)
    row = F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    draw = F.conv(F.substring(F.md5(row), 1, _DIGITS), 16, 10).cast("bigint")
    rows = docs.withColumns({"__size": word_count(F.col(text_col)), "__draw": draw})

    def joined(left: DataFrame, plan: DataFrame) -> DataFrame:
        few = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
        return left.join(few, left[source_col].eqNullSafe(few["__source"])).withColumn("__rate", _rate())

    drawn = work.save(rows.select(source_col, "__size", "__draw"), "drawn")
    sizes = drawn.groupBy(F.col(source_col).alias("source")).agg(F.sum("__size").alias("source_size"))
    plan = targets(sizes, weights=weights, most=most).toDF("__source", "__source_size", "__target")
    plan = work.save(plan, "targets")
    tried = joined(drawn, plan).groupBy("__source", "__source_size", "__target", "__rate")
    tried = tried.agg(F.array(*[F.sum(F.when(_again(F.lit(k)), F.col("__size")).otherwise(0)) for k in range(SHIFTS)]).alias("extra"))
    off = F.transform("extra", lambda x, k: F.struct(F.abs(F.floor("__rate") * F.col("__source_size") + x - F.col("__target")).alias("off"), k.alias("shift")))
    plan = work.save(tried.select("__source", "__source_size", "__target", F.array_min(off)["shift"].cast("bigint").alias("__shift")), "shifts")
    return joined(rows, plan).withColumn("__copies", (F.floor("__rate") + _again(F.col("__shift")).cast("int")).cast("bigint"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix", work: Workspace | None = None) -> DataFrame:
    """docs with size, source_size, target and copies: how many times the mix takes the row."""
    out = _planned(docs, id_col, text_col, source_col, weights, most, seed, work)
    return out.select(*[c for c in docs.columns if c not in _ADDED], *[F.col(f"__{c}").alias(c) for c in _ADDED])


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix", work: Workspace | None = None) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    out = _planned(docs, id_col, text_col, source_col, weights, most, seed, work).where("__copies > 0")
    return out.withColumn("__copy", F.explode(F.expr("sequence(1L, __copies)"))).select(*docs.columns)
