"""Sequential algorithms on one page, as plain functions, each run over sorted pages in one map.

Rows are dealt and sorted by page, and a map takes them batch by batch: many
pages for one start of a Python function, and never more than a batch and one
page in memory. A page's boxes fit there by nature (models give some thousand).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.plans.views import duck_query, spark_view

Rect = tuple[int, int, int, int]

#: A projection has at most so many bins; longer axes are coarser.
BINS = 4096
#: Intersection over union from which a lower score gives way, in one class and across classes; share of a box that counts as inside.
IOU_SAME, IOU_OTHER, INSIDE = np.float32(0.6), np.float32(0.98), np.float32(0.8)
#: A cell is foreground above the first; the mean score that a component needs.
COMPONENT, COMPONENT_SCORE = np.float32(0.05), 0.1


def covered_runs(spans: Sequence[tuple[int, int]], min_gap: int = 1) -> list[tuple[int, int]]:
    """Runs of an axis that the half-open spans cover, cut where at least min_gap of it is bare."""
    top = max((e for _, e in spans), default=0)
    bin_size = max(1, -(-top // BINS)) if top > BINS else 1
    gap = max(1, min_gap // bin_size) if bin_size > 1 else min_gap
    runs: list[list[int]] = []
    for s, e in sorted((max(s, 0) // bin_size, -(-e // bin_size)) for s, e in spans if max(s, 0) < e):
        if runs and s - runs[-1][1] < max(gap, 1):
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    return [(s * bin_size, e * bin_size) for s, e in runs]


def xy_cut(rects: Sequence[Rect], min_gap: int = 1) -> list[int]:
    """Reading order by recursive cuts: columns first, then rows in each column.

    A column that no bare row parts is read from top to bottom. A box belongs
    to the run that its left or upper edge lies in; one that lies in none isn't
    given back.
    """
    out: list[int] = []
    todo: list[list[int]] = [list(range(len(rects)))]
    while todo:
        own = todo.pop()
        if len(own) < 2:
            out += own
            continue
        own = sorted(own, key=lambda i: rects[i][0])
        columns = covered_runs([(rects[i][0], rects[i][2]) for i in own])
        if not columns:
            out += own
            continue
        if rects[own[0]][0] < 0:
            columns.reverse()
        later: list[list[int]] = []
        for left, right in columns:
            column = sorted((i for i in own if left <= abs(rects[i][0]) < right), key=lambda i: rects[i][1])
            rows = covered_runs([(rects[i][1], rects[i][3]) for i in column], min_gap)
            if len(rows) < 2:
                later.append([-1, *column])
                continue
            for top, bottom in rows:
                row = [i for i in column if top <= rects[i][1] < bottom]
                if row:
                    later.append([-1, *row] if len(row) == len(column) else row)
        # a list that starts with -1 is settled; the stack takes them from last to first
        if all(x[0] == -1 for x in later):
            for x in later:
                out += x[1:]
        else:
            todo += [x if x[0] != -1 else _settled(x) for x in reversed(later)]
        while todo and isinstance(todo[-1], _Settled):
            out += todo.pop()
    return out


class _Settled(list):
    """Boxes whose order is final."""


def _settled(marked: list[int]) -> list[int]:
    return _Settled(marked[1:])


def _overlaps(boxes: np.ndarray) -> np.ndarray:
    """Intersection of each box with each."""
    sides = [np.maximum(0, np.minimum(boxes[:, None, k + 2], boxes[None, :, k + 2]) - np.maximum(boxes[:, None, k], boxes[None, :, k])) for k in (0, 1)]
    return (sides[0] * sides[1]).astype(np.float32)


def suppress(boxes: np.ndarray, classes: np.ndarray, scores: np.ndarray) -> list[int]:
    """Positions that stay: greedy suppression by score, then boxes that lie inside others go. Ties keep input order."""
    if not len(boxes):
        return []
    order = np.argsort(-scores, kind="stable")
    boxes, classes = boxes[order], classes[order]
    area = ((boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])).astype(np.float32)
    inter = _overlaps(boxes)
    union = area[:, None] + area[None, :] - inter
    with np.errstate(divide="ignore", invalid="ignore"):
        iou = np.where(union > 0, inter / union, np.float32(0))
        inside = np.where(area[None, :] > 0, inter / area[None, :], np.float32(0))  # of the column's box
    same = classes[:, None] == classes[None, :]
    gone = (iou >= np.where(same, IOU_SAME, IOU_OTHER)) | (same & (inside >= INSIDE))
    left = np.ones(len(boxes), bool)
    for i in range(len(boxes)):
        if left[i]:
            left[i + 1 :] &= ~gone[i, i + 1 :]
    kept = np.flatnonzero(left)
    share = (inside.T >= INSIDE)[np.ix_(kept, kept)]  # row: of which box, column: in which
    live = np.ones(len(kept), bool)
    for i in np.flatnonzero(share.any(1) | share.any(0)):
        if not live[i]:
            continue
        for j in np.flatnonzero((share[i] | share[:, i]) & live):
            if j > i:
                if share[i, j]:
                    live[i] = False
                    break
                live[j] = False
    return order[kept[live]].tolist()


def label_components(foreground: np.ndarray) -> np.ndarray:
    """Each foreground cell's smallest cell number among those joined to it by sides; -1 for the background. Grids of a stack (first axis) are apart."""
    stack = foreground[None] if foreground.ndim == 2 else foreground
    n, high, wide = stack.shape
    labels = np.where(stack, np.arange(high * wide).reshape(1, high, wide), -1)
    while True:
        low = np.where(stack, labels, high * wide)
        best = low.copy()
        best[:, 1:] = np.minimum(best[:, 1:], low[:, :-1])
        best[:, :-1] = np.minimum(best[:, :-1], low[:, 1:])
        best[:, :, 1:] = np.minimum(best[:, :, 1:], low[:, :, :-1])
        best[:, :, :-1] = np.minimum(best[:, :, :-1], low[:, :, 1:])
        best = np.where(stack, best, -1)
        if (best == labels).all():
            return labels.reshape(foreground.shape)
        labels = best


def over_pages(df: DataFrame, pages: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, *order: str, key: str = "page_id") -> DataFrame:
    """pages(rows of whole pages, where each page starts and the end) over df, dealt by page and sorted by it and `order`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            keys = pdf[key].to_numpy()
            cut = int((keys != keys[-1]).sum())
            if not cut and rest and rest[-1][key].iloc[-1] == keys[-1]:
                rest.append(pdf)
                continue
            own = pd.concat([*rest, pdf.iloc[:cut]], ignore_index=True)
            rest = [pdf.iloc[cut:]]
            if len(own):
                yield pages(own, _starts(own[key].to_numpy()))
        if rest:
            own = pd.concat(rest, ignore_index=True)
            yield pages(own, _starts(own[key].to_numpy()))

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


_SIDES = ["x0", "y0", "x1", "y1"]


def order_pages(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
    rects = list(map(tuple, pdf[_SIDES].to_numpy().tolist()))
    orders = [np.array(xy_cut(rects[a:b]), int) + a for a, b in zip(starts, starts[1:], strict=False)]
    own = pdf.iloc[np.concatenate(orders)]
    return pd.DataFrame({"page_id": own["page_id"], "det_no": own["det_no"], "pos": np.concatenate([np.arange(len(o)) for o in orders])})


def suppress_pages(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
    boxes, classes, scores = pdf[_SIDES].to_numpy(np.int64), pdf["class_id"].to_numpy(), pdf["score"].to_numpy(np.float32)
    stay = [np.array(suppress(boxes[a:b], classes[a:b], scores[a:b]), int) + a for a, b in zip(starts, starts[1:], strict=False)]
    return pdf.iloc[np.concatenate(stay)][["page_id", "det_no", "class_id"]]


def component_pages(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
    """Boxes, sizes and mean scores of the components of each page's map; pages of one shape go together."""
    widths = pdf["scores"].map(len).to_numpy()
    shapes: dict[tuple[int, int], list[int]] = {}
    for k, a in enumerate(starts[:-1]):
        shapes.setdefault((int(starts[k + 1] - a), int(widths[a])), []).append(k)
    out = []
    for (high, wide), own in shapes.items():
        rows = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in own])
        grid = np.stack(pdf["scores"].to_numpy()[rows]).astype(np.float32).reshape(len(own), high, wide)
        page, y, x = np.nonzero(grid > COMPONENT)
        label = label_components(grid > COMPONENT)[page, y, x]
        key, each = np.unique(page * (high * wide) + label, return_inverse=True)
        count = np.bincount(each, minlength=len(key))
        ends = []
        for v in (x, y):
            least, most = np.full(len(key), high * wide), np.full(len(key), -1)
            np.minimum.at(least, each, v)
            np.maximum.at(most, each, v)
            ends += [least, most]
        score = np.bincount(each, grid[page, y, x].astype(float), len(key)) / np.maximum(count, 1)
        ids = pdf["page_id"].to_numpy()[starts[np.array(own)][key // (high * wide)]]
        out.append(pd.DataFrame({"page_id": ids, "label": key % (high * wide), "xmin": ends[0], "ymin": ends[2], "xmax": ends[1], "ymax": ends[3], "pixels": count, "score": score.round(6)}))
    return pd.concat(out)


def gated(components: DataFrame, score: float = COMPONENT_SCORE) -> DataFrame:
    """Components of 3 cells and sides of 3 at least, with a mean score of `score`."""
    return components.where((F.col("pixels") >= 3) & (F.col("xmax") - F.col("xmin") >= 2) & (F.col("ymax") - F.col("ymin") >= 2) & (F.col("score") >= score))


def _over(view: str, pages, schema: str, *order: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return over_pages(spark_view(spark, sf_dir, view, {}), pages, schema, *order)

    return run


_components = _over("steps", component_pages, "page_id bigint, label int, xmin int, ymin int, xmax int, ymax int, pixels bigint, score double", "step")

# Greedy suppression as recursion over the ranks of a page: a list of the boxes that stay, then of those that lie inside others.
_SUPPRESSED = """, r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY CAST(score AS REAL) DESC, det_no) AS k, CAST((x1 - x0) * (y1 - y0) AS REAL) AS area FROM v_boxes),
    p AS (SELECT a.page_id, a.k AS i, b.k AS j, a.area AS area_i, b.area AS area_j, a.class_id = b.class_id AS same,
                 CAST(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS REAL) AS inter FROM r a JOIN r b ON a.page_id = b.page_id WHERE a.k < b.k),
    q AS MATERIALIZED (SELECT page_id, i, j, inter / area_i >= CAST(0.8 AS REAL) AS i_in_j, inter / area_j >= CAST(0.8 AS REAL) AS j_in_i,
                 inter / (area_i + area_j - inter) >= CASE WHEN same THEN CAST(0.6 AS REAL) ELSE CAST(0.98 AS REAL) END OR (same AND inter / area_j >= CAST(0.8 AS REAL)) AS gone FROM p WHERE inter > 0),
    by_later AS (SELECT page_id, j AS k, list(i) AS stops FROM q WHERE gone GROUP BY page_id, j),
    by_first AS (SELECT page_id, i AS k, list(j ORDER BY j) FILTER (WHERE i_in_j) AS holders, list(j ORDER BY j) FILTER (WHERE j_in_i) AS held FROM q WHERE i_in_j OR j_in_i GROUP BY page_id, i),
    step AS MATERIALIZED (SELECT r.page_id, r.k, coalesce(stops, []) AS stops, coalesce(holders, []) AS holders, coalesce(held, []) AS held FROM r LEFT JOIN by_later b ON b.page_id = r.page_id AND b.k = r.k LEFT JOIN by_first f ON f.page_id = r.page_id AND f.k = r.k),
    greedy AS (SELECT page_id, 0::BIGINT AS k, []::BIGINT[] AS stay FROM (SELECT DISTINCT page_id FROM r)
               UNION ALL SELECT g.page_id, s.k, CASE WHEN list_has_any(g.stay, s.stops) THEN g.stay ELSE list_append(g.stay, s.k) END FROM greedy g JOIN step s ON s.page_id = g.page_id AND s.k = g.k + 1),
    kept AS MATERIALIZED (SELECT page_id, arg_max(stay, k) AS stay FROM greedy GROUP BY page_id),
    clean AS (SELECT page_id, 0::BIGINT AS k, stay FROM kept
              UNION ALL
              SELECT page_id, k, CASE WHEN NOT list_contains(stay, k) THEN stay ELSE list_filter(stay, lambda x: NOT (x = k AND holder IS NOT NULL) AND NOT (list_contains(held, x) AND (holder IS NULL OR x < holder))) END
              FROM (SELECT c.page_id, s.k, c.stay, s.held, list_min(list_filter(s.holders, lambda x: list_contains(c.stay, x))) AS holder FROM clean c JOIN step s ON s.page_id = c.page_id AND s.k = c.k + 1)),
    last AS (SELECT page_id, arg_max(stay, k) AS stay FROM clean GROUP BY page_id)
    SELECT r.page_id, r.det_no, r.class_id FROM r JOIN last l ON l.page_id = r.page_id AND list_contains(l.stay, r.k)"""


def _recursive(view: str) -> str:
    return duck_query(f"SELECT * FROM {{{view}}}").split(" SELECT * FROM (SELECT * FROM v_")[0].replace("WITH ", "WITH RECURSIVE ", 1)


QUERIES = {
    "xy_cut_order": _over("boxes", order_pages, "page_id bigint, det_no int, pos int", "det_no"),
    "nms_layout": _over("boxes", suppress_pages, "page_id bigint, det_no int, class_id int", "det_no"),
    "components": _components,
    "component_gate": lambda spark, sf_dir: gated(_components(spark, sf_dir)),
}
_LABELLED = (
    _recursive("steps")
    + """, cell AS (SELECT page_id, step * 8 + i AS c, step AS y, i AS x, scores[i + 1] AS s FROM v_steps, range(0, 8) AS t(i) WHERE scores[i + 1] > 0.05::FLOAT),
        reach AS (SELECT page_id, c, c AS seed FROM cell
                  UNION SELECT n.page_id, n.c, r.seed FROM reach r JOIN cell o ON o.page_id = r.page_id AND o.c = r.c
                        JOIN cell n ON n.page_id = o.page_id AND abs(n.x - o.x) + abs(n.y - o.y) = 1),
        named AS (SELECT page_id, c, min(seed) AS label FROM reach GROUP BY page_id, c)
        SELECT page_id, label::INTEGER AS label, min(x)::INTEGER AS xmin, min(y)::INTEGER AS ymin, max(x)::INTEGER AS xmax, max(y)::INTEGER AS ymax, count(*) AS pixels, round(avg(s::DOUBLE), 6) AS score
        FROM named JOIN cell USING (page_id, c) GROUP BY page_id, label"""
)
ORACLES = {
    "components": _LABELLED,
    "component_gate": f"SELECT * FROM ({_LABELLED}) WHERE pixels >= 3 AND xmax - xmin >= 2 AND ymax - ymin >= 2 AND score >= {COMPONENT_SCORE}",
    "nms_layout": _recursive("boxes") + _SUPPRESSED,
}
