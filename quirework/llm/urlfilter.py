"""URL filtering by a path-template tree, in DataFrame functions only.

A host's paths are a tree of segments. Numbers, hexadecimal runs, names with
digits and long names are wildcards from the start. From the top down, a level
below one node is a wildcard too where its values look like draws from an open
set: the share of pages whose value is seen once estimates the chance of a new
value (Good and Turing), and its lower bound at Z standard errors must reach
OPEN. From the bottom up, branches that differ in one fixed segment alone are
compared level by level: those whose labelled share is within Z standard errors
of what the branches show together are merged, so upper levels compare what the
merges below them have left. A template is rejected if its smoothed share of
blocked labels reaches PURITY. Labels come from the rules; the smoothing pulls
templates with few labels towards PRIOR, so an unlabelled template is allowed.

Pages are counted by host and path first; all later steps work on one row a host
and path, each level a written table. Only levels are walked at which some host
has more than one value, so one very deep path costs nothing.

Defined cases: a null url or one without "://" has an empty host and path, no
rule, and the verdict of the empty template; an url of any length is parsed
whole, all its segments count; repeated rows get the same verdict; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm.workspace import Workspace

OPEN, LEAST_LABELS, Z = 0.2, 5, 1.96
PURITY, PRIOR, STRENGTH = 0.8, 0.1, 2.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does. rules: (verdict, host/path)."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, _, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """The segments of a path, variable ones as wildcards."""

    def general(s: Column) -> Column:
        return (
            F.when(s.rlike(r"^[0-9]+$"), "{n}")
            .when(s.rlike(r"^[0-9]+\.[A-Za-z0-9]{1,5}$"), F.concat(F.lit("{n}."), F.regexp_extract(s, r"\.(.*)$", 1)))
            .when(s.rlike(r"^[0-9a-fA-F]{8,}$"), "{x}")
            .when(s.rlike(r"[0-9]"), "{id}")
            .when(F.length(s) > 40, "{long}")
            .otherwise(s)
        )

    return F.transform(F.array_remove(F.split(path, "/"), ""), general)


def _widened(leaves: DataFrame, k: int) -> DataFrame:
    """leaves with level k of their templates as a wildcard below the nodes where its values are open."""
    node = F.slice("template", 1, k)
    values = leaves.where(F.size("template") > k).groupBy("host", node.alias("node"), F.get("template", F.lit(k)).alias("value")).agg(F.sum("pages").alias("pages"))
    once = F.count_if(F.col("pages") == 1)
    nodes = values.groupBy("host", "node").agg(once.alias("once"), F.sum("pages").alias("pages"))
    nodes = nodes.where((F.col("once") - Z * F.sqrt("once")) / F.col("pages") >= OPEN).select("host", "node", F.lit(True).alias("open"))
    wide = F.transform("template", lambda s, i: F.when(i == k, "*").otherwise(s))
    return leaves.withColumn("node", node).join(nodes, ["host", "node"], "left").withColumn("template", F.when(F.col("open"), wide).otherwise(F.col("template"))).drop("node", "open")


def _merged(branches: DataFrame, k: int) -> DataFrame:
    """branches with those merged that differ at level k alone and are alike in their labels."""
    fixed = ~F.coalesce(F.get("merged", F.lit(k)), F.lit("*")).rlike(r"^([*~]|\{.*)$")
    shape = F.transform("merged", lambda s, i: F.when(i == k, "~").otherwise(s))
    known = branches.where(fixed).groupBy("host", "merged").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")).where(F.col("labelled") >= LEAST_LABELS).withColumn("shape", shape)
    pooled = known.groupBy("host", "shape").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b"), F.count("*").alias("k")).where("k > 1")
    share = (F.col("b") + 1) / (F.col("n") + 2)
    similar = F.abs(F.col("blocked") / F.col("labelled") - F.col("b") / F.col("n")) <= Z * F.sqrt(share * (1 - share) * (1 / F.col("labelled") + 1 / F.col("n")))
    renamed = known.join(pooled, ["host", "shape"]).where(similar).select("host", "merged", "shape")
    return branches.join(renamed, ["host", "merged"], "left").withColumn("merged", F.coalesce("shape", "merged")).drop("shape")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], *, id_col: str = "page_id", url_col: str = "url", work: Workspace | None = None) -> DataFrame:
    """One row a page: id, host, path, rule, verdict, template, purity."""
    work = work or Workspace(pages.sparkSession)
    rows = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("label", verdict).withColumn("segments", segments(F.col("path")))

    leaves = rows.groupBy("host", "segments").agg(F.count("*").alias("pages"), F.count("label").alias("labelled"), F.count_if(F.col("label") == "block").alias("blocked"))
    leaves = work.save(leaves.withColumn("template", F.col("segments")), "leaves")
    several = leaves.select("host", F.posexplode("segments").alias("place", "value")).groupBy("host", "place").agg((F.min("value") < F.max("value")).alias("several"))
    places = sorted(r["place"] for r in several.where("several").select("place").distinct().collect())  # at most the segments of the longest path
    for k in places:
        leaves = work.save(_widened(leaves, k), f"wide-{k}")
    branches = leaves.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")).withColumn("merged", F.col("template"))
    for k in reversed(places):
        branches = work.save(_merged(branches, k), f"merged-{k}")

    purity = (F.sum("blocked") + PRIOR * STRENGTH) / (F.sum("labelled") + STRENGTH)
    judged = branches.select("host", "template", "merged").join(branches.groupBy("host", "merged").agg(purity.alias("purity")), ["host", "merged"])
    names = leaves.select("host", "segments", "template").join(judged, ["host", "template"]).select("host", "segments", F.concat(F.lit("/"), F.array_join("merged", "/")).alias("template"), "purity")
    out = rows.join(names, ["host", "segments"])
    chosen = F.coalesce("label", F.when(F.col("purity") >= PURITY, "block").otherwise("allow"))
    return out.select(F.col(id_col), "host", "path", "rule", chosen.alias("verdict"), "template", "purity")
