"""Character scores against brute force on whole texts of any script."""

from collections import Counter

import duckdb
import pytest

from quirework.plans.catalogue import ORACLES, QUERIES

LONG = "Über die Größe der naïve Straße № 7, " * 9
TEXTS = [(0, LONG + "zuletzt XYZ 42"), (1, "漢字とかな 中文 ١٢٣ Ελλάδα"), (2, ""), (3, "q" * 300 + " Ωμέγα 😀"), (4, "plain words"), (5, LONG)]
WANTED = [(10, LONG[:150] + "é" * 80 + "Ÿ tail z"), (11, "漢字と仮名 中文 ١٢ ελλάδα"), (12, "abc ß"), (13, "q" * 290 + "ωμέγα 😀 end")]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def bag(want, got):
    w, g = (Counter(c for c in t if c.isalpha() or c.isnumeric()) for t in (want, got))
    return sum(w.values()), sum((w & g).values())


SCORES = {
    "cer": lambda want, got: (round(edits(got, want) / len(want), 9),),
    "char_presence": lambda want, got: (round(sum(c in got for c in want) / len(want), 9),),
    "char_bag": bag,
}


@pytest.mark.parametrize("name", sorted(SCORES))
def test_whole_texts(spark, tmp_path, name):
    spark.createDataFrame(TEXTS, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(WANTED, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {(i, *SCORES[name](WANTED[i % 4][1], text)) for i, text in TEXTS}
    frame = QUERIES[name](spark, str(tmp_path))
    assert {tuple(r) for r in frame.collect()} == want
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    assert set(con.sql(f"SELECT {', '.join(frame.columns)} FROM ({ORACLES[name]})").fetchall()) == want
