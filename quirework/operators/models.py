"""Stages that run a model: what a provider must do, and the maps that feed it.

A provider is made once in a Python worker by a function without arguments, so
weights are never sent with the plan. Images reach it in chunks of a set size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.operators.pagealgorithms import suppress
from quirework.operators.polygons import crop, quads, resized
from quirework.sources.rasters import ppm_pixels

# Side of the layout model's input, most rows that it gives, crops that an angle classifier takes at once.
# Pages a detector and crops a recogniser takes at once; longest side of the detector's input; widths of crops.
SIDE, MOST_REGIONS, ANGLES = 800, 300, 128
PAGES, CROPS, LONGEST, WIDTHS = 8, 32, 960, (320, 480, 800, 1200, 1600, 2000, 2500, 3200, 4000)


class Provider(Protocol):
    def __call__(self, images: list[np.ndarray]) -> list[np.ndarray]:
        """One result an image: a map of probabilities (detector), or steps x classes (recogniser)."""


class Renderer(Protocol):
    def __call__(self, document: bytes, dpi: int) -> Iterator[tuple[int, np.ndarray]]:
        """(page index from 0, pixels) of each page as it is ready, in any order."""


class TextLayer(Protocol):
    def __call__(self, document: bytes) -> list[dict]:
        """For each page: width, height (points), rotation, and lines as (text, x0, y0, x1, y1) in points, y downwards."""


class OnnxProvider:
    """An ONNX file whose first input takes images of one size."""

    def __init__(self, path: str, threads: int = 1):
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = threads
        self.session = onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])
        self.input = self.session.get_inputs()[0].name

    def __call__(self, images: list[np.ndarray]) -> list[np.ndarray]:
        return [np.squeeze(self.session.run(None, {self.input: x[None]})[0]) for x in images]


_loaded: dict[Callable, Provider] = {}


def _provider(load: Callable[[], Provider]) -> Provider:
    """Functions that a module holds are found again by later tasks of the worker; others are made anew, so few are kept."""
    if load not in _loaded:
        if len(_loaded) > 3:
            _loaded.clear()
        _loaded[load] = load()
    return _loaded[load]


def input_size(width: int, height: int, longest: int = LONGEST) -> tuple[int, int]:
    """The detector's input: at most `longest`, sides in whole 32s."""
    ratio = min(1.0, longest / max(width, height))
    fit = lambda side: max(32, int(side * ratio / 32 + 0.5) * 32)
    return fit(width), fit(height)


def greedy_text(scores: np.ndarray, letters: list[str]) -> tuple[str, float]:
    """Best class of each step without repeats and blanks (class 0), and the mean score of what stays."""
    best = scores.argmax(1)
    keep = (best != np.concatenate(([-1], best[:-1]))) & (best > 0) & (best < len(letters))
    kept = scores.max(1)[keep]
    return "".join(letters[i] for i in best[keep]), float(kept.mean()) if len(kept) else 0.0


def detect(pages: DataFrame, load: Callable[[], Provider], *, image: str = "content", decode: Callable[[bytes], np.ndarray | None] = ppm_pixels) -> DataFrame:
    """(page_id, image bytes) -> page_id, det_no, box (four corners), sorted by rows of ten pixels, then by x. Bytes that are no image give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _provider(load)
        for pdf in batches:
            for at in range(0, len(pdf), PAGES):
                part = pdf.iloc[at : at + PAGES]
                own = [(i, x) for i, x in ((i, decode(b) if b is not None else None) for i, b in zip(part["page_id"], part[image], strict=True)) if x is not None]
                maps = model([resized(x, *input_size(x.shape[1], x.shape[0])) for _, x in own]) if own else []
                rows = []
                for (i, x), found in zip(own, maps, strict=True):
                    boxes = quads(np.asarray(found, np.float32), x.shape[1], x.shape[0])
                    order = sorted(range(len(boxes)), key=lambda k: (int(boxes[k][0][1]) // 10, int(boxes[k][0][0]), k))
                    rows += [(i, n, boxes[k].tolist()) for n, k in enumerate(order)]
                yield pd.DataFrame(rows, columns=["page_id", "det_no", "box"])

    return pages.select("page_id", image).mapInPandas(run, "page_id bigint, det_no int, box array<array<int>>")


def render(documents: DataFrame, load: Callable[[], Renderer], *, dpi: int = 100, body: str = "content", least: int = 1, most: int = 2000) -> DataFrame:
    """(doc_id, bytes) -> doc_id, page_index, width, height, pixels (raw, blue-green-red), error: a row as soon as a page is ready.

    Pages that come twice are taken once. A document that can't be rendered is
    one row with PDF_RENDER_FAILED, one without pages or with more than `most`
    (found as they come, none is kept back) ends with EMPTY_PDF or PDF_TOO_LARGE.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _provider(load)
        row = lambda i, k, x, error: pd.DataFrame([(i, k, *((x.shape[1], x.shape[0], x.tobytes()) if x is not None else (None, None, None)), error)], columns=["doc_id", "page_index", "width", "height", "pixels", "error"])
        for pdf in batches:
            for i, b in zip(pdf["doc_id"], pdf[body], strict=True):
                seen: set[int] = set()
                try:
                    for k, x in model(b or b"", dpi):
                        if k not in seen and len(seen) < most:
                            yield row(i, k, x, None)
                        seen.add(k)
                    error = "EMPTY_PDF" if len(seen) < least else "PDF_TOO_LARGE" if len(seen) > most else None
                except Exception:  # noqa: BLE001  whatever a renderer raises is that document's error
                    error = "PDF_RENDER_FAILED"
                if error:
                    yield row(i, None, None, error)

    return documents.select("doc_id", body).mapInPandas(run, "doc_id bigint, page_index int, width int, height int, pixels binary, error string")


def text_layers(documents: DataFrame, load: Callable[[], TextLayer], *, body: str = "content") -> DataFrame:
    """(doc_id, bytes) -> a row a line: doc_id, page_index, width_pt, height_pt, rotation_deg, k, text, box in points; a page without lines has k null. Unreadable documents give no row, and are read as images."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _provider(load)
        for pdf in batches:
            for i, b in zip(pdf["doc_id"], pdf[body], strict=True):
                try:
                    pages = model(b or b"")
                except Exception:  # noqa: BLE001
                    continue
                rows = []
                for p, page in enumerate(pages):
                    head = (i, p, float(page["width"]), float(page["height"]), int(page.get("rotation", 0)))
                    lines = [(*head, k, text.rstrip(" \t\r\n"), *map(float, box)) for k, (text, *box) in enumerate(page["lines"])]
                    rows += lines or [(*head, None, None, None, None, None, None)]
                yield pd.DataFrame(rows, columns="doc_id page_index width_pt height_pt rotation_deg k text x0 y0 x1 y1".split())

    return documents.select("doc_id", body).mapInPandas(run, "doc_id bigint, page_index int, width_pt double, height_pt double, rotation_deg int, k int, text string, x0 double, y0 double, x1 double, y1 double")


def layer_counters(lines: DataFrame) -> DataFrame:
    """Lines of text layers -> doc_id, page_index, char_count, fffd_count, nonprint_count, rotation_deg, has_lines: what decides whether a page's layer is trusted."""
    text = F.coalesce("text", F.lit(""))
    counts = {"char_count": F.length(text), "fffd_count": F.length(text) - F.length(F.translate(text, "\ufffd", "")), "nonprint_count": F.regexp_count(text, F.lit(r"[\x01-\x08\x0B\x0C\x0E-\x1F]"))}
    return lines.groupBy("doc_id", "page_index").agg(*[F.sum(c).cast("bigint").alias(n) for n, c in counts.items()], F.max("rotation_deg").alias("rotation_deg"), (F.count("k") > 0).alias("has_lines"))


def layout(pages: DataFrame, load: Callable[[], Provider], *, image: str = "content", decode: Callable[[bytes], np.ndarray | None] = ppm_pixels, score: float = 0.3) -> DataFrame:
    """(page_id, image bytes) -> page_id, lid, class_id, score, box of a page's regions.

    The model gives rows of class, score, x0, y0, x1, y1 and its own order (not
    used), in pixels of the page, for images of SIDE x SIDE. Rows of a low score
    or an unknown class go, boxes are clamped, empty ones go, then overlapping
    and enclosed ones, at last images that cover nearly the whole page.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _provider(load)
        for pdf in batches:
            rows = []
            for at in range(0, len(pdf), PAGES):
                part = pdf.iloc[at : at + PAGES]
                own = [(i, x) for i, x in ((i, decode(b) if b is not None else None) for i, b in zip(part["page_id"], part[image], strict=True)) if x is not None]
                found = model([resized(x, SIDE, SIDE, (0, 0, 0), (1, 1, 1)) for _, x in own]) if own else []
                for (i, x), out in zip(own, found, strict=True):
                    rows += [(i, n, *r) for n, r in enumerate(regions(np.asarray(out, np.float32).reshape(-1, 7), x.shape[1], x.shape[0], score))]
            yield pd.DataFrame(rows, columns=["page_id", "lid", "class_id", "score", "x0", "y0", "x1", "y1"])

    return pages.select("page_id", image).mapInPandas(run, "page_id bigint, lid int, class_id int, score double, x0 int, y0 int, x1 int, y1 int")


def regions(found: np.ndarray, width: int, height: int, score: float = 0.3) -> list[tuple[int, float, int, int, int, int]]:
    """Class, score and box of the regions that stay of a layout model's rows for one page."""
    found = found[:MOST_REGIONS]
    found = found[(found[:, 1] >= np.float32(score)) & (found[:, 0] >= 0) & (found[:, 0] < 25)]
    boxes = np.clip(found[:, 2:6].astype(np.int64), 0, [width, height, width, height])
    whole = (boxes[:, 2] > boxes[:, 0]) & (boxes[:, 3] > boxes[:, 1])
    found, boxes = found[whole], boxes[whole]
    classes = found[:, 0].astype(int)
    out = []
    for k in suppress(boxes, classes, found[:, 1]):
        x0, y0, x1, y1 = boxes[k].tolist()
        if classes[k] == 14 and (x1 - x0) * (y1 - y0) > (0.82 if height > width else 0.93) * width * height:
            continue
        out.append((int(classes[k]), float(found[k, 1]), x0, y0, x1, y1))
    return out


def turn_boxes(boxes: DataFrame, load: Callable[[], Provider], *, image: str = "content", decode: Callable[[bytes], np.ndarray | None] = ppm_pixels) -> DataFrame:
    """(page_id, det_no, box, image bytes) -> the same without the image, and turned: upside-down crops have their corners changed over.

    Only boxes that are taller than one and a half times their width are tried.
    The model gives two probabilities, upright and turned; turned wins above 0.9.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _provider(load)
        for pdf in batches:
            quads_, turned = [np.array([list(p) for p in b]) for b in pdf["box"]], np.zeros(len(pdf), bool)
            tall = [k for k, q in enumerate(quads_) if is_tall(q)]
            pixels = _decoded(pdf, tall, image, decode)
            tall = [k for k in tall if pixels[k] is not None]
            for at in range(0, len(tall), ANGLES):
                part = tall[at : at + ANGLES]
                given = model([crop(pixels[k], quads_[k]).transpose(2, 0, 1) for k in part])
                for k, p in zip(part, given, strict=True):
                    turned[k] = p[1] > p[0] and p[1] > 0.9
            box = [(np.roll(q, 2, 0) if t else q).tolist() for q, t in zip(quads_, turned, strict=True)]
            yield pd.DataFrame({"page_id": pdf["page_id"], "det_no": pdf["det_no"], "box": box, "turned": turned})

    return boxes.select("page_id", "det_no", "box", image).mapInPandas(run, "page_id bigint, det_no int, box array<array<int>>, turned boolean")


def is_tall(quad: np.ndarray) -> bool:
    """Whether the longer upright side squared is 2.25 times the longer level side squared, in whole numbers."""
    side = lambda a, b: int(((quad[a] - quad[b]) ** 2).sum() ** 0.5)
    wide, high = max(side(0, 1), side(3, 2)), max(side(0, 3), side(1, 2))
    return high * high >= wide * wide * 225 // 100


def _decoded(pdf: pd.DataFrame, rows: list[int], image: str, decode: Callable[[bytes], np.ndarray | None]) -> dict[int, np.ndarray | None]:
    """Pixels for rows of a batch; neighbours of one page share them."""
    out, last, pixels = {}, None, None
    for k in rows:
        page = pdf["page_id"].iloc[k]
        if last is None or page != last:
            body = pdf[image].iloc[k]
            last, pixels = page, decode(body) if body is not None else None
        out[k] = pixels
    return out


def recognise(boxes: DataFrame, load: Callable[[], Provider], letters: list[str], *, image: str = "content", decode: Callable[[bytes], np.ndarray | None] = ppm_pixels) -> DataFrame:
    """(page_id, det_no, box, image bytes) -> page_id, det_no, text, confidence. Crops of one width bucket go together, padded with zeros."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _provider(load)
        for pdf in batches:
            crops: dict[int, list[tuple[int, int, np.ndarray]]] = {}
            pixels = _decoded(pdf, list(range(len(pdf))), image, decode)
            for k, (i, n, box) in enumerate(zip(pdf["page_id"], pdf["det_no"], pdf["box"], strict=True)):
                if pixels[k] is not None:
                    x = crop(pixels[k], np.array([list(p) for p in box]))
                    crops.setdefault(next(w for w in WIDTHS if w >= x.shape[1]), []).append((i, n, x))
            rows = []
            for width, own in sorted(crops.items()):
                for at in range(0, len(own), CROPS):
                    part = own[at : at + CROPS]
                    padded = [np.pad(x, ((0, 0), (0, width - x.shape[1]), (0, 0))).transpose(2, 0, 1) for _, _, x in part]
                    rows += [(i, n, *greedy_text(np.asarray(s), letters)) for (i, n, _), s in zip(part, model(padded), strict=True)]
            yield pd.DataFrame(rows, columns=["page_id", "det_no", "text", "confidence"])

    return boxes.select("page_id", "det_no", "box", image).mapInPandas(run, "page_id bigint, det_no int, text string, confidence double")
