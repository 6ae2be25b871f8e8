"""Stages behind made-up providers: rendering, text layers, layout, angles."""

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quirework.operators import models

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't find this file


def renderer():
    def pages(document, dpi):
        if document == b"bad":
            raise OSError("no document")
        for k in [*range(len(document)), *[0][: len(document)]]:  # the first page comes twice
            yield k, np.full((2, dpi // 50, 3), document[k], np.uint8)

    return pages


def layer():
    def pages(document):
        if document == b"bad":
            raise OSError("no document")
        return [{"width": 595, "height": 842, "lines": [(f"line {x}\ufffd \r\n", 1, 2, 3, 4)] * (x % 3)} for x in document]

    return pages


def planner():
    return lambda images: [np.float32([(22, 0.9, 0, 0, 3, 2, 1), (22, 0.8, 0, 0, 3, 2, 0), (30, 0.9, 0, 0, 3, 2, 0), (21, 0.2, 0, 0, 3, 2, 0), (8, 0.5, 3, 2, 9, 9, 0)]) for _ in images]


def upside_down():
    return lambda crops: [np.float32([0.05, 0.95]) if x.mean() > 0 else np.float32([0.3, 0.7]) for x in crops]


def test_pages_come_one_by_one_and_errors_as_rows(spark):
    docs = spark.createDataFrame([(1, b"abc"), (2, b"bad"), (3, b""), (4, b"abcdef")], "doc_id bigint, content binary")
    got = models.render(docs, renderer, dpi=150, most=5).collect()
    assert sorted((r.doc_id, r.page_index, r.width, r.height) for r in got if r.error is None) == [*((1, k, 3, 2) for k in range(3)), *((4, k, 3, 2) for k in range(5))]
    assert {(r.doc_id, r.error) for r in got if r.error} == {(2, "PDF_RENDER_FAILED"), (3, "EMPTY_PDF"), (4, "PDF_TOO_LARGE")}
    assert next(bytes(r.pixels) for r in got if r.doc_id == 1 and r.page_index == 1) == b"b" * 18


def test_text_layers_and_their_counters(spark):
    docs = spark.createDataFrame([(1, bytes([3, 4, 5])), (2, b"bad")], "doc_id bigint, content binary")
    lines = models.text_layers(docs, layer)
    assert sorted((r.page_index, r.k if r.k is not None else -1, r.text or "") for r in lines.collect()) == [(0, -1, ""), (1, 0, "line 4\ufffd"), (2, 0, "line 5\ufffd"), (2, 1, "line 5\ufffd")]
    got = {r.page_index: (r.char_count, r.fffd_count, r.nonprint_count, r.has_lines) for r in models.layer_counters(lines).collect()}
    assert got == {0: (0, 0, 0, False), 1: (7, 1, 0, True), 2: (14, 2, 0, True)}


PAGE = b"P6\n4 3\n255\n" + bytes([200] * 36)


def test_regions_of_a_layout_model(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, b"no image")], "page_id bigint, content binary")
    got = [(r.page_id, r.lid, r.class_id, round(r.score, 3), r.x0, r.y0, r.x1, r.y1) for r in models.layout(pages, planner).collect()]
    assert got == [(1, 0, 22, 0.9, 0, 0, 3, 2), (1, 1, 8, 0.5, 3, 2, 4, 3)]
    assert models.regions(np.float32([(14, 0.9, 0, 0, 100, 95, 0), (14, 0.8, 0, 0, 50, 50, 0)]), 100, 100) == []
    assert [r[0] for r in models.regions(np.float32([(14, 0.9, 0, 0, 90, 90, 0)]), 100, 100)] == [14]
    assert models.regions(np.zeros((0, 7), np.float32), 10, 10) == []


def test_only_tall_boxes_are_turned(spark):
    tall, wide = [[0, 0], [1, 0], [1, 3], [0, 3]], [[0, 0], [3, 0], [3, 1], [0, 1]]
    boxes = spark.createDataFrame([(1, 0, tall, PAGE), (1, 1, wide, PAGE), (2, 0, tall, None)], "page_id bigint, det_no int, box array<array<int>>, content binary")
    got = {(r.page_id, r.det_no): (r.turned, r.box) for r in models.turn_boxes(boxes, upside_down).collect()}
    assert got == {(1, 0): (True, [[1, 3], [0, 3], [0, 0], [1, 0]]), (1, 1): (False, wide), (2, 0): (False, tall)}
    dark = boxes.withColumn("content", F.lit(b"P6\n4 3\n255\n" + bytes(36)))
    assert {r.turned for r in models.turn_boxes(dark, upside_down).collect()} == {False}
