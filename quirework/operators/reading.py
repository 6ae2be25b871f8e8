"""Reading order of a page's items: regions by stratum, titles and figures put among them, captions after their figure.

Relational parts (which region holds an item, direction of a page) are SQL; what
depends on the place of the boxes set before is one map over sorted pages. Ties
are broken by number. A page holds as many boxes as a model can give for one
image, so it stays small however many pages there are.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.operators.layout import LAYOUT_ASSIGN
from quirework.operators.pagealgorithms import over_pages, xy_cut
from quirework.plans.views import apply, spark_view

# Class numbers of the layout model.
ASIDE, CHART, DOC_TITLE, FIGURE_TITLE, FOOTER, FOOTER_IMAGE, FOOTNOTE, FORMULA_NUMBER = 2, 3, 6, 7, 8, 9, 10, 11
HEADER, HEADER_IMAGE, IMAGE, PAGE_NUMBER, PARAGRAPH_TITLE, REFERENCE, REFERENCE_CONTENT, SEAL, TABLE, TEXT, VISION_FOOTNOTE = 12, 13, 14, 16, 17, 18, 19, 20, 21, 22, 24
# Strata of the page, and how a class that isn't body text finds its place.
TOP, BOTTOM = {HEADER, HEADER_IMAGE}, {FOOTER, FOOTER_IMAGE, FOOTNOTE, REFERENCE, REFERENCE_CONTENT, VISION_FOOTNOTE}
VISION = {IMAGE, TABLE, CHART}
CROSS_REFERENCE = {REFERENCE, REFERENCE_CONTENT, FOOTNOTE, VISION_FOOTNOTE}
UNORDERED = {ASIDE, PAGE_NUMBER, FORMULA_NUMBER, SEAL}
FIGURES = VISION | {FIGURE_TITLE}
WEIGHED = FIGURES | {DOC_TITLE, PARAGRAPH_TITLE}
# What a gap to the left, right, above and below counts; a line's edge is at its region's edge within so many pixels.
GAP_TITLE, GAP_TITLE_UPRIGHT, GAP_FIGURE = (1.0, 0.1, 0.1, 1.0), (0.2, 0.1, 1.0, 1.0), (1.0, 1.0, 0.1, 1.0)
NEAR_EDGE = 10


class Box(NamedTuple):
    x0: int
    y0: int
    x1: int
    y1: int

    @property
    def sides(self) -> tuple[int, int]:
        """The shorter and the longer side."""
        a, b = sorted((max(0, self.x1 - self.x0), max(0, self.y1 - self.y0)))
        return a, b

    @property
    def radius(self) -> float:
        """Squared distance of the centre from the origin."""
        return (0.5 * (self.x0 + self.x1)) ** 2 + (0.5 * (self.y0 + self.y1)) ** 2


class Lines(NamedTuple):
    """Text lines of a region: their direction, number, mean size, and where the first starts and the last ends."""

    across: bool = True
    n: int = 0
    height: int = 0
    width: int = 0
    start: int = 0
    end: int = 0


@dataclass
class Region:
    number: int
    class_id: int
    box: Box
    lines: Lines = Lines()
    items: list[int] = field(default_factory=list)
    children: list["Region"] = field(default_factory=list)

    def __hash__(self) -> int:
        return self.number


def quotient(a: int, b: int) -> int:
    """Whole division towards zero."""
    return abs(a) // b * (1 if a >= 0 else -1)


def text_lines(boxes: list[Box]) -> Lines:
    """Boxes of a region as lines: a box joins the line before if they share 0.6 of the thinner one."""
    if not boxes:
        return Lines()
    across = 2 * sum(3 * (b.x1 - b.x0) >= 2 * (b.y1 - b.y0) for b in boxes) >= len(boxes)
    thin, long = (1, 0) if across else (0, 1)
    lines: list[list[int]] = []
    for b in sorted(boxes, key=lambda b: b[1] if across else -b[0]):
        if lines:
            line = lines[-1]
            shared = min(line[thin + 2], b[thin + 2]) - max(line[thin], b[thin])
            if shared > 0 and 5 * shared >= 3 * min(line[thin + 2] - line[thin], b[thin + 2] - b[thin]):
                line[:] = [min(line[0], b[0]), min(line[1], b[1]), max(line[2], b[2]), max(line[3], b[3])]
                continue
        lines.append(list(b))
    mean = lambda axis: sum(max(0, x[axis + 2] - x[axis]) for x in lines) // len(lines)
    return Lines(across, len(lines), mean(1), mean(0), lines[0][long], lines[-1][long + 2])


def page_across(regions: Iterable[Region]) -> bool:
    """Whether at least half of the text regions run from left to right."""
    votes = [r.lines.across for r in regions if r.class_id == TEXT]
    return 2 * sum(votes) >= len(votes)


def axis_gap(a: Box, b: Box, axis: int) -> int | None:
    """Distance along an axis; None if the boxes overlap there."""
    if min(a[axis + 2], b[axis + 2]) > max(a[axis], b[axis]):
        return None
    return min(abs(a[axis] - b[axis + 2]), abs(a[axis + 2] - b[axis]))


def distance(a: Box, b: Box) -> int:
    return sum(axis_gap(a, b, axis) or 0 for axis in (0, 1))


def inside_share(a: Box, b: Box) -> float:
    """Overlap as a share of the smaller area."""
    wide, high = min(a.x1, b.x1) - max(a.x0, b.x0), min(a.y1, b.y1) - max(a.y0, b.y0)
    small = min(max(0, x.x1 - x.x0) * max(0, x.y1 - x.y0) for x in (a, b))
    return float(np.float32(wide * high) / np.float32(small)) if wide > 0 and high > 0 and small > 0 else 0.0


def continues(region: Region, before: Region, across: bool) -> bool:
    """Whether a region's first line goes on with the paragraph that ends the region before."""
    a, b = before.lines, region.lines
    if a.n < 2 or not b.n or a.height <= 0 or a.across != across or b.across != across:
        return False
    axis = 0 if across else 1
    return abs(a.end - before.box[axis + 2]) < NEAR_EDGE and abs(b.start - region.box[axis]) < NEAR_EDGE


class Family:
    """Regions that are read right after another one: captions after figures, lower titles after titles, by-lines after the title."""

    def __init__(self, regions: list[Region], line_height: int):
        self.height, self.owner = line_height, {}
        if line_height <= 0:
            return
        of = lambda classes: [r for r in regions if r.class_id in classes]
        text, captions, titles = of({TEXT}), of({FIGURE_TITLE}), of({PARAGRAPH_TITLE})
        for kind, claim, near in ((VISION, self._figure, text + captions), ({PARAGRAPH_TITLE}, self._title, titles), ({DOC_TITLE}, self._heading, text)):
            for parent in of(kind):
                if parent not in self.owner:
                    claim(parent, *self._beside(parent, near))
                    if kind != {PARAGRAPH_TITLE}:
                        for r in text:
                            if r not in self.owner and inside_share(parent.box, r.box) > np.float32(0.9):
                                self._take(parent, r)

    def _take(self, parent: Region, child: Region) -> None:
        self.owner[child] = parent
        parent.children.append(child)

    def _beside(self, parent: Region, near: list[Region]) -> tuple[list[Region], list[Region]]:
        """Regions above and below that share over a tenth of the narrower width, nearest first."""
        p = parent.box
        shared = [r for r in near if (w := min(p.x1, r.box.x1) - max(p.x0, r.box.x0)) > 0 and 10 * w > min(p.x1 - p.x0, r.box.x1 - r.box.x0)]
        above = sorted((r for r in shared if r.box.y1 <= p.y0), key=lambda r: -r.box.y1)
        return above, sorted((r for r in shared if r.box.y0 >= p.y1 and r.box.y1 > p.y0), key=lambda r: r.box.y0)

    def _line(self, r: Region) -> int:
        return r.lines.height if r.lines.height > 0 else max(1, self.height)

    def _count(self, r: Region) -> int:
        return r.lines.n or max(1, max(1, r.box.y1 - r.box.y0) // max(1, self.height))

    def _figure(self, parent: Region, above: list[Region], below: list[Region]) -> None:
        note = False
        for run in (above, below):
            for r in run:
                if r in self.owner or distance(parent.box, r.box) > 2 * self._line(r):
                    break
                if r.class_id == TEXT:
                    if note or not self._caption_like(parent.box, r):
                        break
                    note = True
                self._take(parent, r)

    def _caption_like(self, p: Box, r: Region) -> bool:
        b, (short, long) = r.box, r.box.sides
        if long >= p.sides[1]:
            return False
        centred = abs(quotient(p.x0 + p.x1, 2) - quotient(b.x0 + b.x1, 2)) < 10
        if short < p.sides[0] and long < p.sides[1] // 2 and centred:
            return True
        return self._count(r) == 1 and (abs(p.x0 - b.x0) < 10 or abs(p.x1 - b.x1) < 10)

    def _title(self, parent: Region, above: list[Region], below: list[Region]) -> None:
        for run in (above, below):
            for r in run:
                if r is parent:
                    continue
                line = min(self._line(parent), self._line(r))
                if r in self.owner or abs(r.box.x0 - parent.box.x0) >= 2 * line or distance(parent.box, r.box) > line * 3 // 2:
                    break
                self._take(parent, r)

    def _heading(self, parent: Region, above: list[Region], below: list[Region]) -> None:
        short, long = parent.box.sides
        for r in (run[0] for run in (above, below) if run):
            s, n = r.box.sides
            similar = s >= short * 4 // 5 or long <= n <= long * 3 // 2
            if r not in self.owner and not similar and self._count(r) < 3 and distance(parent.box, r.box) < 2 * self._line(r):
                self._take(parent, r)

    @staticmethod
    def below(parent: Region) -> list[Region]:
        """All that hangs on a region, siblings from top to bottom, then left to right."""
        out, seen, todo = [], {parent}, [parent]
        while todo:
            r = todo.pop()
            if r is not parent:
                if r in seen:
                    continue
                seen.add(r)
                out.append(r)
            todo += sorted(r.children, key=lambda c: (c.box.y0, c.box.x0), reverse=True)
        return out


class Slot(NamedTuple):
    """A place in the order: a region, or an item that lies in none."""

    box: Box
    region: Region | None = None
    item: int = -1


def after_reference(slots: list[Slot], box: Box) -> int:
    """Right after the block that reaches farthest right (then down) of those above; after the first if none is above."""
    reach = [np.float32(s.box.x1) * np.float32(10) + np.float32(s.box.y1) if s.box.y1 <= box.y0 else -np.inf for s in slots]
    return int(np.argmax(reach)) + 1


def after_nearest(slots: list[Slot], box: Box) -> int:
    """Right after the block with the nearest upper left corner."""
    return int(np.argmin([abs(s.box.x0 - box.x0) + abs(s.box.y0 - box.y0) for s in slots])) + 1


def by_radius(slots: list[Slot], box: Box) -> int:
    """Before the first block whose centre is farther from the origin."""
    return next((i for i, s in enumerate(slots) if s.box.radius > box.radius), len(slots))


def by_weight(slots: list[Slot], region: Region, across: bool, line_width: int) -> int:
    """Beside the block with the least weighted gap, then the upper, then the left one; figures don't part a paragraph.

    Numbers are 32-bit: where gaps are large, the left edge no longer counts.
    """
    f, box, title = np.float32, region.box, region.class_id == DOC_TITLE
    left, right, up, down = (GAP_TITLE if across else GAP_TITLE_UPRIGHT) if title else GAP_FIGURE
    snap = max(2, line_width) if title else 2
    first, least, at = f(np.inf), f(np.inf), 0
    for i, (other, of, _) in enumerate(slots):
        dx, dy = axis_gap(box, other, 0), axis_gap(box, other, 1)
        gap = f(dx or 0) * f(left if box.x1 < other.x0 else right) + f(dy or 0) * f(up if box.y1 < other.y0 else down)
        edge, side = (f(other.y0), f(other.x0)) if across else (f(-other.x1), f(other.y0))
        if other.y1 < box.y0 if across else other.x0 > box.x1:
            edge, side = -edge, -side
        if np.isfinite(first) and abs(first - edge) <= snap:
            edge = first
        cost = gap * f(1e4) + edge + side * f(1e-4)
        first = min(first, edge)
        if cost >= least:
            continue
        least, at = cost, i
        neighbour = lambda k: slots[k].region if 0 <= k < len(slots) else None
        figure = region.class_id in FIGURES and of is not None
        if _comes_later(box, other, across):
            at = i + 1
            if figure and neighbour(at) is not None and continues(neighbour(at), of, across):
                at += 1
        elif figure and neighbour(i - 1) is not None and continues(of, neighbour(i - 1), across):
            at = i - 1
    return min(at, len(slots))


def _comes_later(box: Box, other: Box, across: bool) -> bool:
    if quotient(box.y0, 2) != quotient(other.y0, 2):
        return box.y0 > other.y0
    if across and quotient(box.x0, 2) != quotient(box.x1, 2):
        return box.x0 > other.x0
    if not across and box.x0 != box.x1:
        return box.x1 < other.x1
    return int(box.radius) > int(other.radius)


def place(slots: list[Slot], region: Region, across: bool, line_width: int) -> None:
    """Puts a region among those whose order stands, in the way of its class."""
    at = 0
    if slots:
        if region.class_id in CROSS_REFERENCE:
            at = after_reference(slots, region.box)
        elif region.class_id in UNORDERED:
            at = after_nearest(slots, region.box)
        elif region.class_id in WEIGHED:
            at = by_weight(slots, region, across, line_width)
        else:
            at = by_radius(slots, region.box)
    slots.insert(at, Slot(region.box, region))


def cut(slots: list[Slot], across: bool = True, min_gap: int = 1) -> list[Slot]:
    """Slots by recursive cuts, from right to left where lines run downwards; those that no run holds come last."""
    rects = [s.box for s in slots]
    if not across:
        right = max((b.x1 for b in rects), default=0)
        right = max(right, 0)
        rects = [Box(right - b.x1, b.y0, right - b.x0, b.y1) for b in rects]
    order = xy_cut(rects, min_gap)
    rest = set(range(len(slots))) - set(order)
    return [slots[i] for i in [*order, *sorted(rest)]]


def stratum(class_id: int) -> int:
    return 0 if class_id in TOP else 2 if class_id in BOTTOM else 1


def region_order(regions: list[Region], min_gap: int = 1) -> list[int]:
    """Numbers of regions alone: each stratum by recursive cuts."""
    return [s.region.number for k in range(3) for s in cut([Slot(r.box, r) for r in regions if stratum(r.class_id) == k], True, min_gap)]


def rows_of(items: list[Box], members: list[int]) -> list[int]:
    """Items of a region by rows, a row being a third of the upper median height."""
    heights = sorted(max(1, items[i].y1 - items[i].y0) for i in members)
    row = max(4, heights[len(heights) // 2] // 3) if len(members) > 1 else 8
    centre = lambda b: quotient(2 * (b.y0 + b.y1), 4)
    return sorted(members, key=lambda i: (quotient(centre(items[i]), row), items[i].x0 + items[i].x1))


def item_order(items: list[Box], held: list[int], regions: list[Region], min_gap: int = 1) -> list[int]:
    """Positions of items in reading order. ``held`` has the number of each item's region, -1 for none.

    Without regions, or with fewer than one item in twenty inside one, items
    go from top to bottom.
    """
    found = {r.number: r for r in regions}
    for i, number in enumerate(held):
        if number in found:
            found[number].items.append(i)
    loose = [i for i, number in enumerate(held) if number not in found]
    if not regions or len(items) - len(loose) < max(1, -(-5 * len(items) // 100)):
        return sorted(range(len(items)), key=lambda i: (items[i].y0 + items[i].y1, items[i].x0 + items[i].x1))
    for r in regions:
        r.lines = text_lines([items[i] for i in r.items])
        r.items = rows_of(items, r.items)
    across = page_across(regions)
    sized = [r.lines for r in regions if r.class_id == TEXT and r.lines.height > 0]
    width, height = (sum(x.width for x in sized) // len(sized), sum(x.height for x in sized) // len(sized)) if sized else (0, 0)
    family = Family(regions, height)
    order: dict[int, None] = {}
    for k in range(3):
        own = [r for r in regions if stratum(r.class_id) == k and r not in family.owner]
        apart = [r for r in own if r.class_id in WEIGHED | CROSS_REFERENCE | UNORDERED]
        slots = [Slot(r.box, r) for r in own if r not in apart] + ([Slot(items[i], None, i) for i in loose] if k == 1 else [])
        slots = cut(slots, across, min_gap)
        for r in sorted(apart, key=lambda r: r.class_id != DOC_TITLE):
            place(slots, r, across, width)
        for slot in slots:
            if slot.region is None:
                order.setdefault(slot.item)
            else:
                for r in (slot.region, *family.below(slot.region)):
                    order.update(dict.fromkeys(i for i in r.items if i not in order))
    return [*order, *(i for i in range(len(items)) if i not in order)]


def misplaced(boxes: list[Box], tolerance: int) -> list[int]:
    """Positions that differ from rows of ``tolerance`` read from left to right."""
    order = sorted(range(len(boxes)), key=lambda i: (boxes[i].y0, i))
    rows: list[list[int]] = []
    for i in order:
        if rows and abs(boxes[i].y0 - boxes[rows[-1][0]].y0) <= tolerance:
            rows[-1].append(i)
        else:
            rows.append([i])
    want = [i for row in rows for i in sorted(row, key=lambda i: (boxes[i].x0, i))]
    return [pos for pos, i in enumerate(want) if pos != i]


def _boxes(pdf: pd.DataFrame) -> list[Box]:
    return [Box(*map(int, b)) for b in pdf[["x0", "y0", "x1", "y1"]].itertuples(index=False, name=None)]


def _regions(pdf: pd.DataFrame) -> list[Region]:
    pdf = pdf.sort_values("lid")
    return [Region(int(n), int(c), b) for n, c, b in zip(pdf["lid"], pdf["class_id"], _boxes(pdf), strict=True)]


def reading_order(items: DataFrame, regions: DataFrame) -> DataFrame:
    """(page_id, line_no, box) with layout_id, and (page_id, lid, class_id, box) -> page_id, line_no, pos. Pages may lack regions.

    Both go as one tagged table, so that a map reads many pages.
    """
    box = ["x0", "y0", "x1", "y1"]
    none = F.lit(None).cast("int")
    own = items.select("page_id", F.lit(1).alias("kind"), F.col("line_no").cast("int").alias("number"), F.col("layout_id").cast("int").alias("layout_id"), none.alias("class_id"), *box)
    held = regions.select("page_id", F.lit(0).alias("kind"), F.col("lid").cast("int").alias("number"), none.alias("layout_id"), F.col("class_id").cast("int").alias("class_id"), *box)

    def pages(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        first = pdf["kind"].to_numpy()
        boxes = _boxes(pdf)
        numbers, layouts, classes = (pdf[c].fillna(-1).astype(int).tolist() for c in ("number", "layout_id", "class_id"))
        rows, pos = [], []
        for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False):
            at = a + int(np.searchsorted(first[a:b], 1))
            order = item_order(boxes[at:b], layouts[at:b], [Region(numbers[i], classes[i], boxes[i]) for i in range(a, at)])
            rows += [at + i for i in order]
            pos += range(len(order))
        return pd.DataFrame({"page_id": pdf["page_id"].to_numpy()[rows], "line_no": pdf["number"].to_numpy()[rows], "pos": pos})

    return over_pages(own.union(held), pages, "page_id bigint, line_no int, pos int", "kind", "number")


def _order_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made: dict[str, DataFrame] = {}
    items, regions = spark_view(spark, sf_dir, "items", made), spark_view(spark, sf_dir, "classed", made)
    return reading_order(apply(spark, LAYOUT_ASSIGN, {"items": items, "regions": regions}), regions)


def _region_pages(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
    parts = []
    for a, b in zip(starts, starts[1:], strict=False):
        order = region_order(_regions(pdf.iloc[a:b]))
        parts.append(pd.DataFrame({"page_id": pdf["page_id"].iloc[a], "lid": order, "pos": range(len(order))}))
    return pd.concat(parts)


def _child_pages(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
    rows = []
    for a, b in zip(starts, starts[1:], strict=False):
        family = Family(_regions(pdf.iloc[a:b]), 18)
        rows += [(int(pdf["page_id"].iloc[a]), c.number, p.number) for c, p in family.owner.items()]
    return pd.DataFrame(rows, columns=["page_id", "lid", "parent"])


def _region_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_pages(spark_view(spark, sf_dir, "blocks", {}), _region_pages, "page_id bigint, lid int, pos int", "lid")


def _child_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_pages(spark_view(spark, sf_dir, "blocks", {}), _child_pages, "page_id bigint, lid int, parent int", "lid")


QUERIES = {"reading_order": _order_query, "region_order": _region_query, "child_regions": _child_query}
ORACLES: dict[str, str] = {}
