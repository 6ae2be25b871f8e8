"""Derived page tables: the same arithmetic as Spark SQL and as DuckDB SQL.

An operator is one SQL text over named page tables. ``DIV`` is integer division
towards zero; the few constructs that the engines spell differently are macros
of the form ``$NAME(...)`` in DIALECT.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirework.operators.layout import CELL_LINES_DUCK, CELL_LINES_SPARK, CELLS, YX_ORDER
from quirework.operators.requests import ERROR_STATUS, ROUTED

_BOX_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"

#: name -> (tables that it reads, Spark SQL, DuckDB SQL or None where they are the same)
VIEWS: dict[str, tuple[tuple[str, ...], str, str | None]] = {
    "lines": (("documents",), "SELECT doc_id AS page_id, pos AS line_no, col AS text FROM (SELECT doc_id, posexplode(split(text, '\\n')) FROM {documents}) WHERE length(col) > 0", "SELECT page_id, line_no, text FROM (SELECT doc_id AS page_id, (generate_subscripts(s, 1) - 1)::INTEGER AS line_no, unnest(s) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM {documents})) WHERE length(text) > 0"),
    "items": (("lines",), """
        SELECT page_id, line_no, text, x0, y0, CAST(x0 + least(length(text) * 7, 380) AS INT) AS x1, y0 + 18 AS y1, ((page_id * 31 + line_no * 17) % 100) / 100.0D AS confidence, CASE WHEN line_no % 7 = 3 THEN 'pdf' WHEN line_no % 7 = 5 THEN '' ELSE 'ocr' END AS source
        FROM (SELECT *, CAST(40 + (line_no % 2) * 420 + (line_no * 7) % 11 AS INT) AS x0, CAST(60 + (line_no DIV 2) * 24 + (page_id + line_no) % 4 AS INT) AS y0 FROM {lines})""", None),
    "item_pages": (("items",), "SELECT page_id, 900 + CAST(page_id % 3 * 60 AS INT) AS width, max(y1) + 40 AS height, 72 + CAST(page_id % 5 AS INT) * 57 AS dpi FROM {items} GROUP BY page_id", None),
    # pages of no, one, three and five regions
    "regions": (("items",), """
        SELECT page_id, lid, x0 + CAST(page_id % 3 * 6 AS INT) AS x0, y0, x0 + CAST(page_id % 3 * 6 AS INT) + 400 AS x1, y0 + 200 AS y1, CASE page_id % 5 WHEN 0 THEN 12 WHEN 1 THEN 21 WHEN 2 THEN 8 WHEN 3 THEN 6 ELSE 22 END AS class_id, (page_id * 7 + lid * 3) % 97 / 97.0D AS score
        FROM (SELECT DISTINCT page_id FROM {items}) CROSS JOIN (VALUES (0, 30, 50), (1, 450, 50), (2, 30, 260), (3, 450, 260), (4, 30, 470)) AS r(lid, x0, y0)
        WHERE lid < CASE page_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 5 ELSE 3 END""", None),
    "cells": (("items", "regions"), CELLS, None),
    "cell_lines": (("cells",), CELL_LINES_SPARK, CELL_LINES_DUCK),
    "read": (("items",), YX_ORDER, None),
    "page_options": (("items",), "SELECT DISTINCT page_id, page_id % 4 = 1 AS want_layout, page_id % 4 = 2 AS want_order, page_id % 4 = 3 AS want_blocks FROM {items}", None),
    "batch_slots": (("text_pages",), "SELECT page_id, page_id DIV 8 AS batch, page_id % 8 AS slot, CASE WHEN page_id % 9 = 4 THEN 'image_decode_failed' WHEN page_id % 9 = 7 THEN 'empty' END AS error FROM {text_pages}", None),
    "pdf_requests": (("text_pages",), """
        SELECT page_id, page_id DIV 10 AS doc, page_id % 10 AS page_index, CASE page_id DIV 10 % 4 WHEN 0 THEN 'ocr' WHEN 1 THEN 'geometric' WHEN 2 THEN 'auto' ELSE 'auto_verified' END AS mode, page_id DIV 40 % 2 = 0 AS layout, page_id DIV 80 % 2 = 0 AS as_blocks,
               100 + CAST(page_id DIV 10 % 3 AS INT) * 50 AS dpi, 595 AS width_pt, 842 - CAST(page_id % 2 AS INT) * 50 AS height_pt FROM {text_pages}""", None),
    # text layers in points, some lines broken or empty, some missing
    "native_lines": (("items", "item_pages"), """
        SELECT i.page_id, i.line_no AS k, CASE i.line_no % 6 WHEN 1 THEN '' WHEN 2 THEN concat(i.text, '��') WHEN 3 THEN concat(chr(2), i.text) ELSE replace(i.text, 'e', 'E') END AS text,
               i.x0 * 72.0D / p.dpi + 1 AS x0, i.y0 * 72.0D / p.dpi AS y0, i.x1 * 72.0D / p.dpi - 1 AS x1, i.y1 * 72.0D / p.dpi AS y1
        FROM {items} i JOIN {item_pages} p ON p.page_id = i.page_id WHERE i.line_no % 5 <> 4""", None),
    "padded_lines": (("lines",), "SELECT page_id, line_no, concat(CASE WHEN line_no % 2 = 0 THEN '  ' ELSE '' END, replace(text, ' ', CASE line_no % 3 WHEN 0 THEN ' ' WHEN 1 THEN '  ' ELSE chr(9) END), CASE line_no % 4 WHEN 0 THEN '' WHEN 1 THEN ' ' WHEN 2 THEN concat(chr(9), chr(13)) ELSE concat(' ', chr(10)) END) AS text FROM {lines}", None),
    "expected_pages": (("lines",), "SELECT page_id AS doc, line_no DIV 10 + 1 AS page, $SPACED(text, line_no) AS text, count(*) AS n_regions FROM {lines} GROUP BY page_id, line_no DIV 10", None),
    # some pages missing, some lines lost, numbers told, indexed or left out
    "actual_pages": (("lines",), """
        SELECT page_id AS doc, line_no DIV 10 AS position, CASE WHEN page_id % 3 = 0 THEN line_no DIV 10 + 1 END AS page, CASE WHEN page_id % 3 = 1 THEN line_no DIV 10 END AS page_index, $SPACED(text, line_no) AS text, count(*) AS n_regions
        FROM {lines} WHERE (page_id + line_no DIV 10) % 6 <> 0 AND line_no % 7 <> 2 GROUP BY page_id, line_no DIV 10""", None),
    "boxes": (("lineitem",), f"""
        SELECT page_id, det_no, x0, y0, x0 + w AS x1, y0 + h AS y1, class_id, score FROM (
          SELECT l_orderkey DIV 16 AS page_id, CAST(row_number() OVER (PARTITION BY l_orderkey DIV 16 ORDER BY {_BOX_KEY}) - 1 AS INT) AS det_no,
                 CAST((l_partkey * 37) % 760 AS INT) AS x0, CAST((l_suppkey * 53) % 1000 AS INT) AS y0, CAST(15 + l_quantity * 4 AS INT) AS w, 10 + l_linenumber * 9 AS h,
                 CASE l_returnflag WHEN 'R' THEN 14 WHEN 'A' THEN 21 ELSE 22 END AS class_id, l_discount * 10 AS score FROM {{lineitem}})""", None),
    "box_pages": (("boxes",), """
        SELECT page_id, 700 + CAST(page_id % 5 AS INT) * 60 AS width, 900 + CAST(page_id % 3 AS INT) * 90 AS height, CAST(page_id % 4 AS INT) * 90 AS turn, CAST(page_id % 2 AS INT) * 12 AS origin_x, CAST(page_id % 3 AS INT) * 7 AS origin_y,
               50 + CAST(page_id % 6 AS INT) * 110 AS dpi, 320 + CAST(page_id % 3 AS INT) * 320 AS map_width, 640 + CAST(page_id % 2 AS INT) * 320 AS map_height FROM (SELECT DISTINCT page_id FROM {boxes})""", None),
    "quads": (("boxes",), """
        SELECT page_id, det_no, x0 + s AS ax, y0 AS ay, x1 AS bx, y0 + s AS by_, x1 - s AS cx, y1 AS cy, x0 AS dx, y1 - s AS dy FROM (SELECT *, CAST(det_no % 7 AS INT) - 2 AS s FROM {boxes})""", None),
    "labelled": (("boxes",), "SELECT page_id, det_no, CAST(det_no % 27 AS INT) - 1 AS class_id FROM {boxes}", None),
    "images": (("part",), "SELECT p_partkey AS image_id, p_size * 37 AS width, CAST(p_partkey % 50 + 1 AS INT) * 401 AS height FROM {part}", None),
    "classed": (("regions",), "SELECT page_id, lid, x0, y0, x1, y1, CASE (page_id + lid * 3) % 7 WHEN 0 THEN 12 WHEN 1 THEN 17 WHEN 2 THEN 14 WHEN 3 THEN 10 ELSE 22 END AS class_id FROM {regions}", None),
    "blocks": (("boxes",), """
        SELECT page_id, det_no AS lid, x0, y0, x1, y1, CASE det_no % 9 WHEN 0 THEN 6 WHEN 1 THEN 17 WHEN 2 THEN 7 WHEN 3 THEN 14 WHEN 4 THEN 21 WHEN 5 THEN 8 WHEN 6 THEN 12 ELSE 22 END AS class_id
        FROM {boxes}""", None),
    "steps": (("embeddings",), "SELECT vec_id AS page_id, i AS step, slice(embedding, i * 8 + 1, 8) AS scores FROM (SELECT vec_id, embedding, explode(sequence(0, 7)) AS i FROM {embeddings})", "SELECT vec_id AS page_id, i::INTEGER AS step, embedding[i * 8 + 1 : i * 8 + 8] AS scores FROM {embeddings}, range(0, 8) AS t(i)"),
    "calls": (("events",), """
        SELECT event_id, user_id, CASE user_id % 7 WHEN 0 THEN '/ocr' WHEN 1 THEN '/ocr/raw' WHEN 2 THEN '/ocr/batch' WHEN 3 THEN '/ocr/pixels' WHEN 4 THEN '/ocr/pdf' WHEN 5 THEN '/health/live' ELSE '/ocr/none' END AS path,
               CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 400 ELSE 200 END AS status, value / 100 AS duration_s, event_id % 1000 AS bytes, ts AS arrival FROM {events}""", None),
    "requests": (("calls",), ROUTED, None),
    "pixel_bodies": (("events",), """
        SELECT event_id, CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 19 = 0 THEN 'wide' ELSE CAST(event_id % 50 - 1 AS STRING) END AS x_width, CASE WHEN event_id % 23 = 0 THEN '20000' ELSE CAST(user_id % 40 AS STRING) END AS x_height,
               CASE event_id % 5 WHEN 0 THEN '' WHEN 4 THEN '2' WHEN 3 THEN '1' ELSE '3' END AS x_channels, (event_id % 50 - 1) * (user_id % 40) * 3 AS body_bytes FROM {events}""", None),
    "failures": (("events",), f"""
        SELECT event_id, CASE event_id % {len(ERROR_STATUS)} {" ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(ERROR_STATUS))} END AS code, concat('bad "value" ', CAST(event_id AS STRING), chr(9)) AS message FROM {{events}} WHERE event_type IN ('error', 'signup')""", None),
    "text_pages": (("documents",), """
        SELECT doc_id AS page_id, CASE WHEN doc_id % 11 = 0 THEN 0 WHEN doc_id % 11 = 1 THEN 5 ELSE n_chars END AS char_count, CASE WHEN doc_id % 13 = 0 THEN 90 ELSE 0 END AS rotation_deg,
               CASE WHEN doc_id % 7 = 0 THEN n_chars DIV 10 ELSE 0 END AS fffd_count, CASE WHEN doc_id % 9 = 0 THEN n_chars DIV 5 ELSE 0 END AS nonprint_count,
               (length(text) > 0 AND text <> '') AS has_lines, text FROM {documents}""", None),
    "options": (("region",), """
        SELECT a.v AS layout, b.v AS reading_order, c.v AS as_blocks, m.v AS mode, d.v AS dpi, e.v AS available
        FROM (SELECT DISTINCT 1 AS one FROM {region}) CROSS JOIN (VALUES (''), ('1'), ('TRUE'), ('off'), ('maybe')) AS a(v) CROSS JOIN (VALUES (''), ('1'), ('TRUE'), ('off'), ('maybe')) AS b(v)
        CROSS JOIN (VALUES (''), ('1'), ('TRUE'), ('off'), ('maybe')) AS c(v) CROSS JOIN (VALUES ('ocr'), ('geometric'), ('auto'), ('auto_verified'), ('Auto')) AS m(v)
        CROSS JOIN (VALUES (49), (50), (100), (600), (601)) AS d(v) CROSS JOIN (VALUES (true), (false)) AS e(v)""", None),
}

#: DuckDB's levenshtein counts bytes: each kind of character of the second text becomes a one-byte code, all others of the first text become one more.
_DUCK_EDITS = (
    r"(SELECT CASE WHEN len(k) > 126 THEN CAST(error('more than 126 kinds of characters') AS BIGINT) ELSE levenshtein("
    r"translate(\1, array_to_string(k || o, ''), array_to_string(list_transform(range(1, len(k) + 1), lambda i: chr(CAST(i AS INTEGER))), '') || repeat(chr(127), len(o))), "
    r"translate(\2, array_to_string(k, ''), array_to_string(list_transform(range(1, len(k) + 1), lambda i: chr(CAST(i AS INTEGER))), ''))) END "
    r"FROM (SELECT k, list_filter(list_distinct(string_split(\1, '')), lambda c: NOT list_contains(k, c)) AS o FROM (SELECT list_distinct(string_split(\2, '')) AS k)))"
)

#: macro -> (Spark, DuckDB); \\1, \\2 are its arguments, which hold no comma or bracket.
DIALECT: dict[str, tuple[str, str]] = {
    r"\$JOIN\(([^,()]+), ([^()]+)\)": (r"listagg(\1, '') WITHIN GROUP (ORDER BY \2)", r"string_agg(\1, '' ORDER BY \2)"),
    r"\$COMMA\(([^,()]+), ([^()]+)\)": (r"listagg(\1, ',') WITHIN GROUP (ORDER BY \2)", r"string_agg(\1, ',' ORDER BY \2)"),
    r"\$SPACED\(([^,()]+), ([^()]+)\)": (r"listagg(\1, ' ') WITHIN GROUP (ORDER BY \2)", r"string_agg(\1, ' ' ORDER BY \2)"),
    r"\$MINBY\(([^,()]+), ([^,()]+)\)": (r"min_by(\1, \2)", r"arg_min(\1, \2)"),
    r"\$INTEGER\(([^,()]+)\)": (r"try_cast(\1 AS BIGINT)", r"try_cast(\1 AS BIGINT)"),
    r"\$SQUEEZE\(([^,()]+)\)": (r"trim(regexp_replace(lower(\1), '[\\\\s]+', ' '))", r"trim(regexp_replace(lower(\1), '[\\s]+', ' ', 'g'))"),
    r"\$QUOTE\(([^,()]+)\)": (r"substr(to_json(named_struct('v', \1)), 6, length(to_json(named_struct('v', \1))) - 6)", r"to_json(\1)::VARCHAR"),
    r"\$G5\(([^,()]+)\)": (r"c_number(CAST(\1 AS DOUBLE))", r"printf('%.5g', CAST(\1 AS DOUBLE))"),
    r"\$ARGMAX\(([^,()]+)\)": (r"array_position(\1, array_max(\1)) - 1", r"list_position(\1, list_max(\1)) - 1"),
    r"\$MAX\(([^,()]+)\)": (r"array_max(\1)", r"list_max(\1)"),
    r"\$NONPRINT\(([^,()]+)\)": (r"regexp_count(\1, '[\\\\x01-\\\\x08\\\\x0B\\\\x0C\\\\x0E-\\\\x1F]')", r"len(regexp_extract_all(\1, '[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F]'))"),
    r"\$RTRIM\(([^,()]+), ([^$]+)\)\$": (r"trim(TRAILING \2 FROM \1)", r"rtrim(\1, \2)"),
    r"\$ASCII\(([^,()]+)\)": (r"regexp_replace(\1, '[^ -~]', '')", r"regexp_replace(\1, '[^ -~]', '', 'g')"),
    r"\$OVER\(([^,()]+), ([^,()]+)\)": (r"size(filter(\1, x -> x > \2))", r"len(list_filter(\1, lambda x: x > \2))"),
    r"\$PRESENT\(([^,()]+), ([^,()]+)\)": (r"size(filter(split(\1, ''), c -> c <> '' AND position(c IN \2) > 0))", r"len(list_filter(string_split(\1, ''), lambda c: c <> '' AND position(c IN \2) > 0))"),
    r"\$TOKENS\(([^,()]+)\)": (r"regexp_extract_all(lower(\1), '[a-z0-9]+', 0)", r"regexp_extract_all(lower(\1), '[a-z0-9]+')"),
    r"\$LETTERS\(([^,()]+)\)": (r"regexp_extract_all(\1, '[\\\\pL\\\\pN]', 0)", r"regexp_extract_all(\1, '[\\pL\\pN]')"),
    r"\$EDITS\(([^,()]+), ([^,()]+)\)": (r"levenshtein(\1, \2)", _DUCK_EDITS),
    r"\$EXPLODE\(": ("explode(", "unnest("),
    r"\$SIZE\(": ("size(", "len("),
    r"\$NTH\(([^,()]+), ([^,()]+)\)": (r"sort_array(collect_list(\1))[CAST(\2 AS INT)]", r"list_sort(list(\1))[CAST(\2 AS INT) + 1]"),
    r"\$FLOAT\(": ("float(", "to_real("),
}


@F.pandas_udf(T.StringType())
def c_number(x: pd.Series) -> pd.Series:
    """Five significant digits as C prints them: an exact tie goes to the even digit, which the JVM's formats and rounding of doubles don't do."""
    return x.map("{:.5g}".format, na_action="ignore").astype(object)


def dialect(sql: str, engine: int) -> str:
    for pattern, texts in DIALECT.items():
        sql = re.sub(pattern, texts[engine], sql)
    if engine:
        sql = re.sub(r"\bDIV\b", "//", sql)
        sql = re.sub(r"(\d\.\d+)D\b", r"\1::DOUBLE", sql)
        sql = sql.replace("to_real(", "CAST_REAL(")
        while "CAST_REAL(" in sql:
            at = sql.index("CAST_REAL(")
            depth, i = 0, at + 9
            while True:
                depth += {"(": 1, ")": -1}.get(sql[i], 0)
                if not depth:
                    break
                i += 1
            sql = f"{sql[:at]}CAST({sql[at + 10 : i]} AS REAL){sql[i + 1 :]}"
    return sql


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def spark_view(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame]) -> DataFrame:
    if name not in made:
        if name in VIEWS:
            _, sql, _ = VIEWS[name]
            made[name] = apply(spark, sql, {x: spark_view(spark, sf_dir, x, made) for x in _names(sql)})
        else:
            made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return made[name]


def apply(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The operator over page tables given as DataFrames."""
    text = dialect(sql, 0)
    if "c_number(" in text:
        spark.udf.register("c_number", c_number)
    for name in tables:
        text = text.replace("{" + name + "}", "__" + name + "__")
    text = text.replace("{", "{{").replace("}", "}}")
    for name in tables:
        text = text.replace("__" + name + "__", "{" + name + "}")
    return spark.sql(text, **tables)


def spark_query(sql: str):
    """A registered query: the operator over the derived views of a folder."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made: dict[str, DataFrame] = {}
        return apply(spark, sql, {x: spark_view(spark, sf_dir, x, made) for x in _names(sql)})

    return run


def duck_query(sql: str) -> str:
    """The same operator as one DuckDB statement over the plain tables."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in VIEWS and name not in order:
            text = VIEWS[name][2] or VIEWS[name][1]
            for x in _names(text):
                need(x)
            order.append(name)

    for x in _names(sql):
        need(x)
    views = [f"v_{x} AS MATERIALIZED ({VIEWS[x][2] or VIEWS[x][1]})" for x in order]
    text = dialect(f"WITH {', '.join(views)} SELECT * FROM ({sql})" if views else sql, 1)
    return re.sub(r"\{(\w+)\}", lambda m: f"v_{m[1]}" if m[1] in VIEWS else m[1], text)
