"""Hand-written cases for the algorithms on one page."""

import numpy as np

from quirework.operators.pagealgorithms import covered_runs, label_components, suppress, xy_cut
from quirework.sources.images import jpeg_size, webp_size
from quirework.streaming.requests import limit_calls


def test_runs_are_cut_where_the_axis_is_bare():
    assert covered_runs([(0, 2), (5, 7), (8, 9)]) == [(0, 2), (5, 7), (8, 9)]
    assert covered_runs([(0, 4), (4, 6)]) == [(0, 6)]
    assert covered_runs([(0, 4), (6, 8)], 3) == [(0, 8)]
    assert covered_runs([(3, 3)]) == []


def test_two_columns_are_read_one_after_the_other():
    left, right = [(0, y, 100, y + 10) for y in (0, 20, 40)], [(200, y, 300, y + 10) for y in (0, 20, 40)]
    rects = [x for pair in zip(left, right, strict=True) for x in pair]
    assert xy_cut(rects) == [0, 2, 4, 1, 3, 5]


def test_a_header_joins_the_columns_below_into_rows():
    rects = [(200, 50, 300, 60), (0, 50, 100, 60), (0, 0, 300, 20), (0, 70, 100, 80)]
    assert xy_cut(rects) == [2, 1, 0, 3]


def test_every_box_comes_once():
    rng = np.random.default_rng(1)
    for _ in range(50):
        p = rng.integers(0, 500, (30, 2))
        rects = [(int(x), int(y), int(x + w), int(y + h)) for (x, y), (w, h) in zip(p, rng.integers(1, 120, (30, 2)), strict=True)]
        assert sorted(xy_cut(rects)) == list(range(30))


def test_suppression_by_score_class_and_containment():
    boxes = np.array([[0, 0, 100, 100], [5, 5, 100, 100], [0, 0, 100, 100], [10, 10, 20, 20], [300, 0, 400, 100]])
    assert suppress(boxes, np.array([1, 1, 2, 1, 1]), np.float32([0.9, 0.8, 0.7, 0.6, 0.5])) == [0, 4]
    assert suppress(boxes[:0], np.array([]), np.float32([])) == []


def test_components_join_by_sides_only():
    grid = np.array([[1, 0, 1], [0, 1, 1], [1, 1, 0]], bool)
    assert label_components(grid).tolist() == [[0, -1, 2], [-1, 2, 2], [2, 2, -1]]


def test_headers_of_other_formats():
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x10\x00\x20\x03"
    assert jpeg_size(jpeg) == (32, 16)
    assert jpeg_size(b"\xff\xd8\xff") is None
    vp8x = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    assert webp_size(vp8x) == (100, 50)


def test_limit_counts_what_it_held_back():
    rows, state = limit_calls(list(range(50)), None, 10, 1000)
    assert sum(p for _, p, _ in rows) == 10
    rows, _ = limit_calls([1000], state, 10, 1000)
    assert rows == [(1000, True, 40)]
