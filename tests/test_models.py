"""Polygons, pixmaps and model stages on hand-written cases."""

import numpy as np

from quirework.operators.models import detect, greedy_text, input_size, recognise
from quirework.operators.polygons import area, away, crop, crop_map, grown, hull, mean_inside, projective, quads, resized, smallest_rectangle
from quirework.sources.rasters import bounded, model_paths, ppm_pixels, read_labels, time_ordered_id

RECT = np.array([(10, 10), (50, 10), (50, 30), (10, 30)])


def test_rectangles():
    quad, side = smallest_rectangle(RECT)
    assert quad.tolist() == RECT.tolist() and side == 20
    quad, side = smallest_rectangle(np.array([(10, 0), (20, 10), (10, 20), (0, 10)]))
    assert abs(side - np.hypot(10, 10)) < 1e-9 and sorted(map(tuple, quad.tolist())) == [(0, 10), (10, 0), (10, 20), (20, 10)]
    assert smallest_rectangle(np.array([(3, 4), (3, 4)]))[1] == 0
    assert smallest_rectangle(np.array([(0, 0), (9, 0)]))[1] == 0
    assert away(np.array([2.5, -2.5, 0.49])).tolist() == [3, -3, 0]


def test_growth_moves_sides_outwards():
    # 800 * 1.5 / 120 = 10 on each side
    quad, _ = smallest_rectangle(grown(RECT))
    assert quad.tolist() == [[0, 0], [60, 0], [60, 40], [0, 40]]
    assert area(hull(RECT)) == 800
    assert grown(np.array([(1, 1)])).tolist() == [[1, 1]]


def test_mean_of_a_polygon_and_of_a_degenerate_one():
    prob = np.full((100, 100), 0.8, np.float32)
    assert abs(mean_inside(prob, RECT) - 0.8) < 1e-6
    assert mean_inside(prob, np.array([(10, 10), (50, 10)])) == 0
    prob[10:31, 10:30] = 0
    assert 0.35 < mean_inside(prob, RECT) < 0.45


def test_quads_of_a_map():
    prob = np.zeros((64, 64), np.float32)
    prob[10:21, 8:49] = 0.9
    prob[40:42, 5:40] = 0.9  # too thin
    prob[50:60, 50:60] = 0.4  # too weak
    (quad,) = quads(prob, 128, 64)
    assert quad[0][0] < 16 < quad[1][0] and quad[0][1] < 10 and quad[2][1] > 20
    assert quads(np.zeros((8, 8), np.float32), 8, 8).shape == (0, 4, 2)


def test_crops_are_turned_when_tall():
    assert crop_map(np.array([(0, 0), (100, 0), (100, 30), (0, 30)]))[1:] == (160, False)
    assert crop_map(np.array([(0, 0), (20, 0), (20, 100), (0, 100)]))[1:] == (240, True)
    assert crop_map(np.array([(5, 5)] * 4))[1:] == (1, True)
    square = np.array([(0, 0), (10, 0), (10, 10), (0, 10)])
    m = projective(square, square + 3)
    assert np.allclose(m, [[1, 0, 3], [0, 1, 3], [0, 0, 1]], atol=1e-5)
    assert not projective(np.zeros((4, 2)), square).any()
    image = np.zeros((48, 96, 3), np.uint8)
    image[:, 48:] = 255
    out = crop(image, np.array([(0, 0), (96, 0), (96, 48), (0, 48)]))
    assert out.shape == (48, 96, 3) and out[0, 0, 0] == -1 and out[0, 95, 0] == 1


def test_resizing_keeps_a_plain_image():
    out = resized(np.full((10, 20, 3), 255, np.uint8), 64, 32, (0, 0, 0), (1, 1, 1))
    assert out.shape == (3, 32, 64) and np.allclose(out, 1)
    assert input_size(1920, 960) == (960, 480) and input_size(10, 10) == (32, 32)


def test_pixmaps():
    assert ppm_pixels(b"P6\n# c\n1 1\n255\n\x01\x02\x03").tolist() == [[[3, 2, 1]]]
    assert ppm_pixels(b"P5 2 1 255\n\x07\x08").tolist() == [[[7, 7, 7], [8, 8, 8]]]
    for bad in (b"", b"P3 1 1 255\n0", b"P5 2 1 255\n\x07", b"P5 0 1 255\n", b"P5 1 1 65535\n\0\0"):
        assert ppm_pixels(bad) is None


def test_settings(spark, tmp_path):
    assert model_paths({}) == ("models/rec.onnx", "models/keys.txt")
    assert model_paths({"OCR_LANG": "greek", "REC_DICT": "d"}) == ("models/rec/greek/rec.onnx", "d")
    assert [bounded(x, 7, 1, 10) for x in (None, "x", "3", "99", "-4")] == [7, 7, 3, 10, 1]
    (tmp_path / "keys.txt").write_bytes(b"a\r\nb\n")
    assert read_labels(spark, str(tmp_path / "keys.txt")) == ["blank", "a", "b", " "]
    ids = [r[0] for r in spark.range(20).select(time_ordered_id().alias("u")).collect()]
    assert len(set(ids)) == 20 and all(len(x) == 36 and x[14] == "7" and x[19] in "89ab" for x in ids)


def test_greedy_decoding():
    letters = ["blank", "a", "b", "c", " "]
    steps = np.eye(5)[[1, 1, 0, 2, 2, 3]] * 0.9
    assert greedy_text(steps, letters) == ("abc", steps.max(1)[0])
    assert greedy_text(np.eye(5)[[0, 0]], letters) == ("", 0.0)


def test_model_stages(spark):
    def bright():  # takes bright pixels for text
        return lambda images: [(x.mean(0) > 0).astype(np.float32) for x in images]

    def reader():
        return lambda images: [np.eye(3, dtype=np.float32)[[1, 2, 2]] for _ in images]

    pixels = np.zeros((64, 96), np.uint8)
    pixels[20:32, 16:80] = 255
    page = b"P5 96 64 255\n" + pixels.tobytes()
    df = spark.createDataFrame([(1, page), (2, b"no image"), (3, None)], "page_id bigint, content binary")
    boxes = detect(df, bright)
    rows = boxes.collect()
    assert [(r.page_id, r.det_no) for r in rows] == [(1, 0)] and rows[0].box[0][0] < 16 and rows[0].box[2][0] > 78
    got = recognise(boxes.join(df, "page_id"), reader, ["blank", "a", "b"]).collect()
    assert [(r.page_id, r.det_no, r.text, r.confidence) for r in got] == [(1, 0, "ab", 1.0)]
