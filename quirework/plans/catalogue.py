"""All registered queries over recognised pages, with their DuckDB statements."""

from __future__ import annotations

import importlib

from pyspark.sql import functions as F

from quirework.plans.views import duck_query, spark_query

_SQL_MODULES = ("operators.layout", "operators.output", "operators.recognition", "operators.textlayer", "operators.requests", "operators.scoring", "functions.geometry")
_CODE_MODULES = ("operators.pagealgorithms", "operators.reading", "sources.images", "sources.rasters", "streaming.requests")

#: Whole-number columns that the engines type differently; both give a bigint.
_BIGINT = {
    "blocks_flagship": "x1", "item_json": "id", "layout_assign": "x1", "row_tolerance": "tolerance", "cell_order": "pos x1", "block_rank": "order_index", "projection_segments": "island",
    "detection_sort": "pos", "yx_fallback_order": "pos", "native_text_sanity": "n", "box_distances": "cx cy", "binarise": "foreground", "block_json": "oi",
    "request_metrics": "client_error le_0 le_1 le_2 le_3 le_4 le_5 le_6 le_7 le_8 ok server_error sum_us", "stream_metrics": "server_errors", "page_direction": "cells across_cells",
    "page_lines": "line_height line_width", "region_line_counts": "n_lines", "text_lines": "height width n", "quad_box": "centre_y", "projection_scale": "scale", "page_scores": "page",
}


def _whole(name: str, query):
    def run(spark, sf_dir):
        return query(spark, sf_dir).withColumns({c: F.col(c).cast("bigint") for c in _BIGINT[name].split()})

    return run if name in _BIGINT else query


def _whole_sql(name: str, sql: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _BIGINT[name].split())}) FROM ({sql})" if name in _BIGINT else sql


QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in _SQL_MODULES:
    for _query, _sql in importlib.import_module(f"quirework.{_name}").QUERIES.items():
        QUERIES[_query] = spark_query(_sql)
        ORACLES[_query] = duck_query(_sql)
for _name in _CODE_MODULES:
    _module = importlib.import_module(f"quirework.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
QUERIES = {name: _whole(name, query) for name, query in QUERIES.items()}
ORACLES = {name: _whole_sql(name, sql) for name, sql in ORACLES.items()}
