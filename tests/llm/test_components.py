"""Connected components, at the cost of their edges."""

import random

import pytest

from quirework.llm.components import components
from quirework.llm.workspace import Workspace


def by_force(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    return {x: root(x) for x in parent}


draw = random.Random(5)
GRAPHS = {
    "path": [(i, i + 1) for i in range(300)],
    "star": [(i, 900) for i in range(400)],
    "sparse": [(draw.randrange(600), draw.randrange(600)) for _ in range(400)],
    "cliques": [(g * 50 + i, g * 50 + j) for g in range(8) for i in range(20) for j in range(i)],
    "repeats": [(1, 1), (2, 3), (3, 2), (2, 3), (-5, 3)],
    "empty": [],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    """As by force; all rounds together write fewer edges than there were, so no join repeats them all."""
    written = {}

    class Counted(Workspace):
        def save(self, df, table, **options):
            out = super().save(df, table, **options)
            written[table] = out.count()
            return out

    work = Counted(spark)
    got = components(spark.createDataFrame(GRAPHS[name], "a bigint, b bigint").repartition(3), work, "x")
    assert {r.node: r.component for r in got.collect()} == by_force(GRAPHS[name])
    work.clear()
    later = [n for t, n in written.items() if t.startswith("x-edges-") and t != "x-edges-0"]
    assert later and sum(later) <= written["x-edges-0"]
