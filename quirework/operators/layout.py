"""Layout regions and text items: assignment, orphans, blocks, gates, neighbours.

Each operator is SQL over page tables. Every join holds the page key; ranges
are filters beside it, so no plan needs a nested loop over pages. Sizes, classes
and the number of a page's regions come from the tables; a page may have any
number of regions, or none. (page_id, line_no), (page_id, lid) and
(page_id, det_no) name one row each.
"""

# Names of the layout classes 0 to 24.
CLASS_NAMES = (
    "abstract", "algorithm", "aside_text", "chart", "content", "display_formula", "doc_title", "figure_title", "footer", "footer_image", "footnote", "formula_number", "header",
    "header_image", "image", "inline_formula", "number", "paragraph_title", "reference", "reference_content", "seal", "table", "text", "vertical_text", "vision_footnote",
)

CLASS_NAME = "CASE class_id " + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(CLASS_NAMES)) + " ELSE 'SupplementaryRegion' END"

_ASSIGNED = """
    SELECT a.page_id, a.line_no, a.text, a.x0, a.y0, a.x1, a.y1, a.confidence, a.source, a.layout_id, a.region_x1, coalesce(n.n, 0) AS n_regions
    FROM (SELECT i.page_id, i.line_no, i.text, i.x0, i.y0, i.x1, i.y1, i.confidence, i.source, min(r.lid) AS layout_id, $MINBY(r.x1, r.lid) AS region_x1
          FROM {items} i LEFT JOIN {regions} r ON r.page_id = i.page_id
            AND (i.x0 + i.x1) / 2.0D BETWEEN r.x0 AND r.x1 AND (i.y0 + i.y1) / 2.0D BETWEEN r.y0 AND r.y1
          GROUP BY i.page_id, i.line_no, i.text, i.x0, i.y0, i.x1, i.y1, i.confidence, i.source) a
    LEFT JOIN (SELECT page_id, CAST(count(*) AS INT) AS n FROM {regions} GROUP BY page_id) n ON n.page_id = a.page_id"""

#: Items and the first region that holds their centre, edges included; null if none does.
LAYOUT_ASSIGN = f"SELECT page_id, line_no, text, x0, y0, x1, y1, confidence, layout_id FROM ({_ASSIGNED})"

#: Items with the cell that they are read in: their region, or the one after the last for orphans; null on a page without regions.
CELLS = f"SELECT *, coalesce(layout_id, CASE WHEN n_regions > 0 THEN n_regions END) AS cell FROM ({_ASSIGNED})"

#: Regions and, on pages with regions and orphans, one region around the orphans, with the next number, class -1 and score 1.
SUPPLEMENTARY_REGION = """
    SELECT page_id, lid, class_id, score, x0, y0, x1, y1 FROM {regions}
    UNION ALL
    SELECT page_id, max(n_regions) AS lid, -1 AS class_id, 1.0D AS score, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
    FROM {cells} WHERE layout_id IS NULL AND n_regions > 0 GROUP BY page_id"""

# One exchange by (page, cell): the upper median height is the one whose rank is half the count.
_SIZED = """
    SELECT *, CASE WHEN n < 2 THEN 8 ELSE greatest(4, med DIV 3) END AS tolerance FROM (
      SELECT *, max(CASE WHEN height_rank = n DIV 2 + 1 THEN h END) OVER (PARTITION BY page_id, cell) AS med FROM (
        SELECT *, greatest(1, y1 - y0) AS h, count(*) OVER (PARTITION BY page_id, cell) AS n, row_number() OVER (PARTITION BY page_id, cell ORDER BY greatest(1, y1 - y0), line_no) AS height_rank
        FROM {cells} WHERE cell IS NOT NULL))"""

#: Row tolerance of a cell: a third of the upper median height, 4 at least; 8 for a single item.
ROW_TOLERANCE = f"SELECT page_id, cell, n, tolerance FROM ({_SIZED}) WHERE height_rank = 1"

_ORDERED = f"SELECT *, row_number() OVER (PARTITION BY page_id, cell ORDER BY ((y0 + y1) * 2 DIV 4) DIV tolerance, x0 + x1, line_no) - 1 AS pos FROM ({_SIZED})"

#: Items of each cell in reading order: by row of the tolerance's height, then from left to right.
CELL_ORDER = f"SELECT page_id, cell, line_no, text, x0, y0, x1, y1, pos FROM ({_ORDERED})"


def blocks(placed: str) -> str:
    """Paragraph blocks of items with page_id, cell, region_x1, text, box and pos.

    A line follows the one before after a space if it is on the same row (half a
    line's height) or if that one reaches the region's right edge, else after a
    line break. Lines are as high as the cell's text lines, 8 where there are none.
    """
    return f"""
    SELECT page_id, cell, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_items, min(pos) AS first_pos, $JOIN(part, pos) AS content
    FROM (SELECT *, CASE WHEN prev_cy IS NULL THEN text
                         WHEN abs(cy - prev_cy) <= line_h DIV 2 THEN concat(' ', text)
                         WHEN prev_x1 >= right_x - greatest(8, line_h) THEN concat(' ', text) ELSE concat(chr(10), text) END AS part
          FROM (SELECT p.*, (p.y0 + p.y1) * 2 DIV 4 AS cy, lag((p.y0 + p.y1) * 2 DIV 4) OVER (PARTITION BY p.page_id, p.cell ORDER BY p.pos) AS prev_cy,
                       lag(p.x1) OVER (PARTITION BY p.page_id, p.cell ORDER BY p.pos) AS prev_x1, CASE WHEN l.height > 0 THEN l.height ELSE 8 END AS line_h,
                       coalesce(p.region_x1, max(p.x1) OVER (PARTITION BY p.page_id, p.cell)) AS right_x
                FROM ({placed}) p JOIN {{cell_lines}} l ON l.page_id = p.page_id AND l.cell = p.cell))
    GROUP BY page_id, cell"""


#: Paragraph blocks in the order of their cell.
BLOCKS = f"SELECT page_id, cell, x0, y0, x1, y1, n_items, content FROM ({blocks(_ORDERED)})"

#: Blocks numbered by the first of their items in the page's order.
BLOCK_RANK = """
    SELECT page_id, cell, row_number() OVER (PARTITION BY page_id ORDER BY first_pos) - 1 AS order_index
    FROM (SELECT c.page_id, c.cell, min(r.pos) AS first_pos FROM {cells} c JOIN {read} r ON r.page_id = c.page_id AND r.line_no = c.line_no WHERE c.cell IS NOT NULL GROUP BY c.page_id, c.cell)"""

#: Layout boxes of score 0.3 and more, a known class, clamped to their page and not empty.
LAYOUT_GATE = """
    SELECT page_id, det_no, class_id, score, x0, y0, x1, y1 FROM (
      SELECT b.page_id, b.det_no, b.class_id, b.score, greatest(0, least(b.x0, p.width)) AS x0, greatest(0, least(b.y0, p.height)) AS y0, greatest(0, least(b.x1, p.width)) AS x1, greatest(0, least(b.y1, p.height)) AS y1
      FROM {boxes} b JOIN {box_pages} p ON p.page_id = b.page_id WHERE b.score >= 0.3 AND b.class_id >= 0 AND b.class_id < 25)
    WHERE x1 > x0 AND y1 > y0"""

#: Drops images that cover nearly the whole page: over 0.82 of a portrait one, 0.93 of any other.
OVERSIZED_IMAGE = """
    SELECT b.page_id, b.det_no, b.class_id FROM {boxes} b JOIN {box_pages} p ON p.page_id = b.page_id
    WHERE NOT (b.class_id = 14 AND CAST((b.x1 - b.x0) * (b.y1 - b.y0) AS DOUBLE) > (CASE WHEN p.height > p.width THEN 0.82D ELSE 0.93D END) * p.width * p.height)"""

#: Overlapping pairs of a page with intersection over union, and the share of the second that lies in the first.
IOU_PAIRS = """
    SELECT page_id, a, b, inter, round(inter / (area_a + area_b - inter), 9) AS iou, round(inter / area_b, 9) AS inside, round(inter / least(area_a, area_b), 9) AS small FROM (
      SELECT page_id, a, b, wide * high * 1.0D AS inter, area_a, area_b FROM (
        SELECT x.page_id, x.det_no AS a, y.det_no AS b, least(x.x1, y.x1) - greatest(x.x0, y.x0) AS wide, least(x.y1, y.y1) - greatest(x.y0, y.y0) AS high,
               (x.x1 - x.x0) * (x.y1 - x.y0) * 1.0D AS area_a, (y.x1 - y.x0) * (y.y1 - y.y0) * 1.0D AS area_b
        FROM {boxes} x JOIN {boxes} y ON y.page_id = x.page_id)
      WHERE a < b AND wide > 0 AND high > 0)"""

#: The nearest box above and below each, among those that share over a tenth of the narrower one's width.
NEAREST_NEIGHBOURS = """
    SELECT page_id, det_no, max(CASE WHEN up = 1 THEN other END) AS above, max(CASE WHEN down = 1 THEN other END) AS below FROM (
      SELECT page_id, det_no, other,
             CASE WHEN above THEN row_number() OVER (PARTITION BY page_id, det_no, above ORDER BY oy1 DESC, other) END AS up,
             CASE WHEN below THEN row_number() OVER (PARTITION BY page_id, det_no, below ORDER BY oy0, other) END AS down
      FROM (SELECT x.page_id, x.det_no, y.det_no AS other, y.y0 AS oy0, y.y1 AS oy1, y.y1 <= x.y0 AS above, y.y0 >= x.y1 AS below
            FROM {boxes} x JOIN {boxes} y ON y.page_id = x.page_id AND y.det_no <> x.det_no
             AND (least(x.x1, y.x1) - greatest(x.x0, y.x0)) * 10 > least(x.x1 - x.x0, y.x1 - y.x0)))
    GROUP BY page_id, det_no"""

#: Runs of the x axis that some box of the page covers, touching runs joined.
PROJECTION_SEGMENTS = """
    SELECT page_id, island, min(x0) AS seg_start, max(x1) AS seg_end, count(*) AS n FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY page_id ORDER BY x0, x1, det_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
      FROM (SELECT *, CASE WHEN x0 <= max(x1) OVER (PARTITION BY page_id ORDER BY x0, x1, det_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {boxes}))
    GROUP BY page_id, island"""

#: Boxes in the order of detection: by rows of ten pixels, then from left to right.
DETECTION_SORT = "SELECT page_id, det_no, row_number() OVER (PARTITION BY page_id ORDER BY y0 DIV 10, x0, det_no) - 1 AS pos FROM {boxes}"

#: Items by centre from top to bottom, then left to right, where no layout helps.
YX_ORDER = "SELECT page_id, line_no, row_number() OVER (PARTITION BY page_id ORDER BY y0 + y1, x0 + x1, line_no) - 1 AS pos FROM {items}"

#: Whether a page has too few items inside regions to read it by layout.
COVERAGE = "SELECT page_id, count(*) AS n, count(layout_id) AS matched, count(layout_id) < greatest(1, ceil(count(*) * 0.05D)) AS falls_back FROM {cells} GROUP BY page_id"

#: Name, reading bucket (0 top, 1 body, 2 bottom) and order label of each box's class.
CLASS_LABELS = f"""
    SELECT page_id, det_no, class_id, {CLASS_NAME} AS class_name,
           CASE WHEN class_id IN (12, 13) THEN 0 WHEN class_id IN (8, 9, 10, 18, 19, 24) THEN 2 ELSE 1 END AS bucket,
           CASE WHEN class_id = 6 THEN 'doc_title' WHEN class_id = 17 THEN 'paragraph_title' WHEN class_id = 7 THEN 'vision_title' WHEN class_id IN (14, 21, 3) THEN 'vision'
                WHEN class_id IN (18, 19, 10, 24) THEN 'cross_reference' WHEN class_id IN (2, 16, 11, 20) THEN 'unordered' ELSE 'body' END AS order_label
    FROM {{labelled}}"""

#: Direction of a page by the vote of its text regions, whose own is the vote of their lines; without one, and in a tie, left to right.
PAGE_DIRECTION = """
    SELECT p.page_id, count(t.cell) AS cells, coalesce(sum(CASE WHEN t.across THEN 1 ELSE 0 END), 0) AS across_cells, 2 * coalesce(sum(CASE WHEN t.across THEN 1 ELSE 0 END), 0) >= count(t.cell) AS across
    FROM (SELECT DISTINCT page_id FROM {cells}) p
    LEFT JOIN (SELECT l.page_id, l.cell, l.across FROM {cell_lines} l JOIN {regions} r ON r.page_id = l.page_id AND r.lid = l.cell AND r.class_id = 22) t ON t.page_id = p.page_id
    GROUP BY p.page_id"""

#: Mean height and width of the text lines of a page: of its text regions that have lines.
PAGE_LINES = """
    SELECT l.page_id, sum(l.height) DIV count(*) AS line_height, sum(l.width) DIV count(*) AS line_width
    FROM {cell_lines} l JOIN {regions} r ON r.page_id = l.page_id AND r.lid = l.cell AND r.class_id = 22 WHERE l.height > 0 GROUP BY l.page_id"""

#: Lines of a region: as clustered, else as many of the page's mean height as fit.
REGION_LINE_COUNTS = f"""
    SELECT r.page_id, r.lid, coalesce(CASE WHEN l.n > 0 THEN l.n END, greatest(1, greatest(1, r.y1 - r.y0) DIV greatest(1, coalesce(p.line_height, 0)))) AS n_lines
    FROM {{regions}} r LEFT JOIN {{cell_lines}} l ON l.page_id = r.page_id AND l.cell = r.lid LEFT JOIN ({PAGE_LINES}) p ON p.page_id = r.page_id"""

#: A region starts a paragraph unless the one before has lines enough, runs to its end edge, and this one begins at its start edge (within 10), all in the page's direction.
PARAGRAPH_START = f"""
    SELECT page_id, lid, NOT coalesce(prev_n >= 2 AND n > 0 AND prev_height > 0 AND prev_across = across AND own_across = across
             AND CASE WHEN across THEN abs(prev_end - prev_x1) < 10 AND abs(line_start - x0) < 10 ELSE abs(prev_end - prev_y1) < 10 AND abs(line_start - y0) < 10 END, false) AS starts
    FROM (SELECT r.page_id, r.lid, r.x0, r.y0, d.across, l.n, l.across AS own_across, l.line_start,
                 lag(l.n) OVER (PARTITION BY r.page_id ORDER BY r.lid) AS prev_n, lag(l.height) OVER (PARTITION BY r.page_id ORDER BY r.lid) AS prev_height,
                 lag(l.across) OVER (PARTITION BY r.page_id ORDER BY r.lid) AS prev_across, lag(l.line_end) OVER (PARTITION BY r.page_id ORDER BY r.lid) AS prev_end,
                 lag(r.x1) OVER (PARTITION BY r.page_id ORDER BY r.lid) AS prev_x1, lag(r.y1) OVER (PARTITION BY r.page_id ORDER BY r.lid) AS prev_y1
          FROM {{regions}} r LEFT JOIN {{cell_lines}} l ON l.page_id = r.page_id AND l.cell = r.lid JOIN ({PAGE_DIRECTION}) d ON d.page_id = r.page_id)"""

# Text lines of a cell, as a view for both engines: boxes in order (from the top, or from the right where they run downwards)
# join the line before if they share 0.6 of the thinner one with all of it so far.
_LINED = """
    SELECT page_id, cell, line_no, across, CASE WHEN across THEN y0 ELSE -x0 END AS k, CASE WHEN across THEN y0 ELSE x0 END AS lo, CASE WHEN across THEN y1 ELSE x1 END AS hi,
           CASE WHEN across THEN x0 ELSE y0 END AS o0, CASE WHEN across THEN x1 ELSE y1 END AS o1
    FROM (SELECT *, 2 * sum(CASE WHEN 3 * (x1 - x0) >= 2 * (y1 - y0) THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, cell) >= count(*) OVER (PARTITION BY page_id, cell) AS across
          FROM {cells} WHERE cell IS NOT NULL)"""

CELL_LINES_SPARK = f"""
    SELECT page_id, cell, across, size(ls) AS n,
           CASE WHEN across THEN aggregate(ls, 0, (a, l) -> a + greatest(0, l.hi - l.lo)) ELSE aggregate(ls, 0, (a, l) -> a + greatest(0, l.o1 - l.o0)) END DIV size(ls) AS height,
           CASE WHEN across THEN aggregate(ls, 0, (a, l) -> a + greatest(0, l.o1 - l.o0)) ELSE aggregate(ls, 0, (a, l) -> a + greatest(0, l.hi - l.lo)) END DIV size(ls) AS width,
           ls[0].o0 AS line_start, element_at(ls, -1).o1 AS line_end
    FROM (SELECT page_id, cell, across, aggregate(bs, CAST(array() AS array<struct<lo:int,hi:int,o0:int,o1:int>>), (acc, b) ->
             CASE WHEN size(acc) > 0 AND least(element_at(acc, -1).hi, b.hi) > greatest(element_at(acc, -1).lo, b.lo)
                       AND 5 * (least(element_at(acc, -1).hi, b.hi) - greatest(element_at(acc, -1).lo, b.lo)) >= 3 * least(element_at(acc, -1).hi - element_at(acc, -1).lo, b.hi - b.lo)
                  THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('lo', least(element_at(acc, -1).lo, b.lo), 'hi', greatest(element_at(acc, -1).hi, b.hi), 'o0', least(element_at(acc, -1).o0, b.o0), 'o1', greatest(element_at(acc, -1).o1, b.o1))))
                  ELSE concat(acc, array(named_struct('lo', b.lo, 'hi', b.hi, 'o0', b.o0, 'o1', b.o1))) END) AS ls
          FROM (SELECT page_id, cell, across, sort_array(collect_list(named_struct('k', k, 'line_no', line_no, 'lo', lo, 'hi', hi, 'o0', o0, 'o1', o1))) AS bs FROM ({_LINED}) GROUP BY page_id, cell, across))"""

CELL_LINES_DUCK = f"""
    WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY page_id, cell ORDER BY k, line_no) AS i FROM ({_LINED})),
    f AS (SELECT page_id, cell, across, i, lo, hi, o0, o1, 1 AS line FROM o WHERE i = 1
          UNION ALL
          SELECT page_id, cell, across, i, CASE WHEN j THEN least(lo, blo) ELSE blo END, CASE WHEN j THEN greatest(hi, bhi) ELSE bhi END, CASE WHEN j THEN least(o0, bo0) ELSE bo0 END, CASE WHEN j THEN greatest(o1, bo1) ELSE bo1 END, CASE WHEN j THEN line ELSE line + 1 END
          FROM (SELECT f.page_id, f.cell, f.across, o.i, f.lo, f.hi, f.o0, f.o1, f.line, o.lo AS blo, o.hi AS bhi, o.o0 AS bo0, o.o1 AS bo1,
                       least(f.hi, o.hi) > greatest(f.lo, o.lo) AND 5 * (least(f.hi, o.hi) - greatest(f.lo, o.lo)) >= 3 * least(f.hi - f.lo, o.hi - o.lo) AS j
                FROM f JOIN o ON o.page_id = f.page_id AND o.cell = f.cell AND o.i = f.i + 1)),
    g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY page_id, cell, line ORDER BY i DESC) = 1)
    SELECT page_id, cell, across, CAST(count(*) AS INT) AS n, CAST(sum(CASE WHEN across THEN greatest(0, hi - lo) ELSE greatest(0, o1 - o0) END) // count(*) AS BIGINT) AS height,
           CAST(sum(CASE WHEN across THEN greatest(0, o1 - o0) ELSE greatest(0, hi - lo) END) // count(*) AS BIGINT) AS width, min(o0) FILTER (WHERE line = 1) AS line_start, arg_max(o1, line) AS line_end
    FROM g GROUP BY page_id, cell, across"""

QUERIES = {
    "page_direction": PAGE_DIRECTION, "page_lines": PAGE_LINES, "region_line_counts": REGION_LINE_COUNTS, "text_lines": "SELECT * FROM {cell_lines}",
    "blocks_flagship": BLOCKS, "layout_assign": LAYOUT_ASSIGN, "supplementary_region": SUPPLEMENTARY_REGION, "row_tolerance": ROW_TOLERANCE, "cell_order": CELL_ORDER,
    "block_rank": BLOCK_RANK, "layout_gate": LAYOUT_GATE, "oversized_image": OVERSIZED_IMAGE, "iou_pairs": IOU_PAIRS, "nearest_neighbours": NEAREST_NEIGHBOURS,
    "projection_segments": PROJECTION_SEGMENTS, "detection_sort": DETECTION_SORT, "yx_fallback_order": YX_ORDER, "reading_coverage": COVERAGE, "class_labels": CLASS_LABELS,
    "paragraph_start": PARAGRAPH_START,
}
