"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.workspace import Workspace


def components(edges: DataFrame, work: Workspace, name: str, rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) of every node on an edge a-b.

    Each round maps every node to the first among itself and its neighbours in an
    order drawn by hash, then on to that node's own, and edges to the pairs of
    what their ends map to. Edges inside a component shrink to nothing, so a round
    costs what the rounds before have left. A drawn order has no long chains; a
    star ends after two rounds of one order, and every third round draws another.
    Sums by node combine before the shuffle; nothing is gathered. Each round's
    tables are written.
    """
    left = work.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges-0")
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    heads = work.save(nodes.select("node", F.col("node").alias("head")), f"{name}-heads-0")
    for k in range(1, rounds + 1):
        seed = F.lit((k - 1) // 3)
        both = left.union(left.select("b", "a"))
        first = F.min(F.struct(F.xxhash64("b", seed), F.col("b").alias("to"))).alias("first")
        drawn = both.groupBy("a").agg(first).select("a", F.least("first", F.struct(F.xxhash64("a", seed), F.col("a").alias("to")))["to"].alias("to"))
        drawn = work.save(drawn, f"{name}-drawn")
        moved = work.save(drawn.join(drawn.select(F.col("a").alias("to"), F.col("to").alias("further")), "to").select(F.col("a").alias("node"), F.col("further").alias("to")), f"{name}-moved")
        ends = left.join(moved.select(F.col("node").alias("a"), F.col("to").alias("p")), "a").join(moved.select(F.col("node").alias("b"), F.col("to").alias("q")), "b")
        left = work.save(ends.where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), f"{name}-edges-{k}")
        heads = work.save(heads.join(moved.withColumnRenamed("node", "head"), "head", "left").select("node", F.coalesce("to", "head").alias("head")), f"{name}-heads-{k}")
        work.drop(f"{name}-drawn", f"{name}-moved", f"{name}-edges-{k - 1}", f"{name}-heads-{k - 1}")
        if not left.limit(1).count():
            least = heads.groupBy("head").agg(F.min("node").alias("component"))
            labels = work.save(heads.join(least, "head").select("node", "component"), name)
            work.drop(f"{name}-edges-{k}", f"{name}-heads-{k}")
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
