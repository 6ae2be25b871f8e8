"""Quality rules and cross-document line frequency, in DataFrame functions only.

Lines are normalised (lower case, white space collapsed, trimmed) and hashed.
A line that more than ``most_documents`` documents of one host hold is removed
there; a document that keeps less than ``least_share`` of its words is rejected
as depleted. Base rules reject short and self-repeating documents.

A host with a third of all documents, or one very common line, is counted
before it is shuffled; the join back meets one row a line and host.

Defined cases: a null text has no words and fails the base rules; a null host
is a host of its own; repeated rows count as documents of their own and get the
same result; a text of any length is one row and counted whole; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm.workspace import Workspace

MOST_DOCUMENTS, LEAST_SHARE = 100, 0.5
LEAST_WORDS, MOST_REPEATED = 50, 50
_SPACE = "\t\n\x0b\x0c\r"


def bind(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _SPACE, " " * len(_SPACE)), " +"), "")


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that the text holds twice or more.

    Windows are hashed to 64 bits. Most texts repeat none, which shows without
    a sort. Else hashes and places are sorted as plain numbers: the place takes
    the low bits that it needs, and neighbours are compared by the whole hash.
    """

    def windows(w: Column) -> Column:
        places = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def count(h: Column) -> Column:
        low = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin(F.size(h)))) - 1
        place = lambda s, k, bits: F.get(s, k).bitwiseAND(bits).cast("int")
        packed = lambda bits: F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(bits)).bitwiseOR(i.cast("bigint"))))

        def starts(s: Column, bits: Column) -> Column:
            own = lambda k: F.get(h, place(s, k, bits))
            same = F.filter(s, lambda x, k: (own(k) == own(k - 1)) | (own(k) == own(k + 1)))
            return F.sort_array(F.transform(same, lambda x: x.bitwiseAND(bits).cast("int")))

        covered = F.aggregate(
            bind(low, lambda bits: bind(packed(bits), lambda s: starts(s, bits))),
            F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
            lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")),
            lambda a: a["n"],
        )
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered)

    return bind(bind(words, windows), count).cast("bigint")


def text_facts(text: Column) -> Column:
    """n_words, word_chars, n_repeat_words, lines (hash and words of each normalised line that has a word): lines are split into words once."""

    def facts(per_line: Column, words: Column) -> Column:
        line = lambda w: F.struct(F.xxhash64(F.lower(F.array_join(w, " "))).alias("h"), F.size(w).alias("n"))
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"), F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"), repeated_words(words).alias("n_repeat_words"),
            F.transform(F.filter(per_line, lambda w: F.size(w) > 0), line).alias("lines"),
        )

    return bind(F.transform(F.split(text, "\n"), words_of), lambda per_line: bind(F.flatten(per_line), lambda words: facts(per_line, words)))


def lines_of(text: Column) -> Column:
    """The lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def line_hash(line: Column) -> Column:
    """Of a line in lower case, white space collapsed and trimmed."""
    return F.xxhash64(F.lower(F.array_join(words_of(line), " ")))


def base_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and lines (hash and words of each normalised line)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    repeated_lines = bind(lines_of(text), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    out = docs.withColumn("__facts", text_facts(text))
    return (
        out.withColumns({c: F.col(f"__facts.{c}") for c in ("n_words", "word_chars", "n_repeat_words", "lines")})
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("bigint"))
        .withColumn("n_dup_lines", repeated_lines.cast("bigint"))
        .withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
        .drop("__facts")
    )


def judge_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most_documents: int = MOST_DOCUMENTS, least_share: float = LEAST_SHARE, work: Workspace | None = None) -> DataFrame:
    """One row a document: id, mark (a hash of the text), the base columns, n_common_words (in removed lines), kept, common (hashes of those lines).

    Texts are read once; what follows works on a table of line hashes and counts.
    """
    work = work or Workspace(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), text.alias("text"))
    rows = work.save(base_rules(rows.withColumn("mark", F.xxhash64("text"))).drop("text"), "rows")

    each = rows.select("id", "mark", "host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("line"))
    common = each.groupBy("host", "line").agg(F.count("*").alias("documents")).where(F.col("documents") > most_documents)
    common = work.save(common.select(F.col("host").alias("c_host"), F.col("line").alias("c_line")), "common")
    found = each.join(common, each["host"].eqNullSafe(F.col("c_host")) & (F.col("line") == F.col("c_line")))
    found = found.groupBy("id", "mark").agg(F.collect_set("line").alias("common")).select(F.col("id").alias("f_id"), F.col("mark").alias("f_mark"), "common")

    judged = rows.join(found, rows["id"].eqNullSafe(F.col("f_id")) & (rows["mark"] == F.col("f_mark")), "left")
    gone = F.aggregate(F.filter("lines", lambda x: F.array_contains("common", x["h"])), F.lit(0), lambda a, x: a + x["n"])
    judged = judged.withColumn("n_common_words", F.when(F.col("common").isNull(), 0).otherwise(gone).cast("bigint"))
    kept = ~F.col("base_failed") & (F.col("n_words") - F.col("n_common_words") >= least_share * F.col("n_words"))
    return judged.select(F.col("id").alias(id_col), "mark", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_common_words", kept.alias("kept"), "common")


def remove_lines(docs: DataFrame, judged: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept documents, their text without the lines that judge_lines found too common. All columns of docs stay."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    marks = judged.where("kept").select(F.col(id_col).alias("__id"), F.col("mark").alias("__mark"), F.col("common").alias("__common")).dropDuplicates(["__id", "__mark"])
    out = docs.join(marks, docs[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__mark")))
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("__common", line_hash(x))), "\n")
    return out.withColumn(text_col, F.when(F.col("__common").isNull(), text).otherwise(left)).select(*docs.columns)
