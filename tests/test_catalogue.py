"""Every query over recognised pages against DuckDB."""

import duckdb
import pytest

from quirework.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_duckdb(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir).toArrow()  # noqa: F841  read by DuckDB
    columns = ", ".join(f'"{c}"' for c in sorted(got.column_names))
    duck.sql(f"CREATE OR REPLACE TABLE want AS {ORACLES[name]}")
    assert sorted(got.column_names) == sorted(r[0] for r in duck.sql("DESCRIBE want").fetchall())
    duck.register("got", got)
    for a, b in (("got", "want"), ("want", "got")):
        assert not duck.sql(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b} LIMIT 3").fetchall()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
