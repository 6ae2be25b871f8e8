"""JSON that clients get: items, regions, blocks, pages, batches, documents. One line of SQL text per record, no spaces, keys in a fixed order.

Orders, options, slots' errors and page sizes come from the tables {read},
{page_options}, {batch_slots} and {pdf_requests}.
"""

from quirework.operators.layout import CLASS_NAME, SUPPLEMENTARY_REGION, blocks
from quirework.operators.textlayer import QUALITY

_QUAD = "concat('[[', x0, ',', y0, '],[', x1, ',', y0, '],[', x1, ',', y1, '],[', x0, ',', y1, ']]')"

#: Items as JSON. The source is told where it isn't recognition, the region where the page has any.
ITEM_JSON = f"""
    SELECT page_id, line_no, id, concat('{{"id":', id, ',"text":', $QUOTE(text), ',"confidence":', $G5(confidence), ',"bounding_box":', {_QUAD},
           CASE WHEN source IN ('', 'ocr') THEN '' ELSE concat(',"source":"', source, '"') END, CASE WHEN cell IS NULL THEN '' ELSE concat(',"layout_id":', cell) END, '}}') AS item
    FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY line_no) - 1 AS id FROM {{cells}})"""

#: Regions as JSON, the added one included.
LAYOUT_JSON = f"""
    SELECT page_id, lid, concat('{{"id":', lid, ',"class":"', {CLASS_NAME}, '","class_id":', class_id, ',"confidence":', $G5(score), ',"bounding_box":', {_QUAD}, '}}') AS region
    FROM ({SUPPLEMENTARY_REGION})"""

_PLACED = """
    SELECT c.page_id, c.cell, c.region_x1, c.text, c.x0, c.y0, c.x1, c.y1, r.pos
    FROM {cells} c JOIN {read} r ON r.page_id = c.page_id AND r.line_no = c.line_no WHERE c.cell IS NOT NULL"""

#: Paragraph blocks as JSON, numbered by the first of their items in the page's order; the box is the region's.
BLOCK_JSON = f"""
    SELECT page_id, oi, concat('{{"id":', oi, ',"layout_id":', cell, ',"class":"', {CLASS_NAME}, '","bounding_box":', {_QUAD}, ',"content":', $QUOTE(content), ',"order_index":', oi, '}}') AS block
    FROM (SELECT b.page_id, b.cell, b.content, s.class_id, s.x0, s.y0, s.x1, s.y1, row_number() OVER (PARTITION BY b.page_id ORDER BY b.first_pos) - 1 AS oi
          FROM ({blocks(_PLACED)}) b JOIN ({SUPPLEMENTARY_REGION}) s ON s.page_id = b.page_id AND s.lid = b.cell)"""

# Every part of a page's response as text; null where the page has none.
_PARTS = f"""
    SELECT p.page_id, i.items, l.regions, o.ids, b.blocks FROM (SELECT DISTINCT page_id FROM {{cells}}) p
    LEFT JOIN (SELECT page_id, $COMMA(item, id) AS items FROM ({ITEM_JSON}) GROUP BY page_id) i ON i.page_id = p.page_id
    LEFT JOIN (SELECT page_id, $COMMA(region, lid) AS regions FROM ({LAYOUT_JSON}) GROUP BY page_id) l ON l.page_id = p.page_id
    LEFT JOIN (SELECT page_id, $COMMA(id, pos) AS ids FROM (
                 SELECT n.page_id, CAST(n.id AS STRING) AS id, r.pos FROM (SELECT page_id, line_no, row_number() OVER (PARTITION BY page_id ORDER BY line_no) - 1 AS id FROM {{cells}}) n
                 JOIN {{read}} r ON r.page_id = n.page_id AND r.line_no = n.line_no) GROUP BY page_id) o ON o.page_id = p.page_id
    LEFT JOIN (SELECT page_id, $COMMA(block, oi) AS blocks FROM ({BLOCK_JSON}) GROUP BY page_id) b ON b.page_id = p.page_id"""

#: What follows the items in a response: regions, order and blocks, each if asked for (one asks for those before it) and if the page has regions.
_MORE = """concat(CASE WHEN (want_layout OR want_order OR want_blocks) AND regions IS NOT NULL THEN concat(',"layout":[', regions, ']') ELSE '' END,
           CASE WHEN (want_order OR want_blocks) AND regions IS NOT NULL THEN concat(',"reading_order":[', coalesce(ids, ''), ']') ELSE '' END,
           CASE WHEN want_blocks AND regions IS NOT NULL THEN concat(',"blocks":[', coalesce(blocks, ''), ']') ELSE '' END)"""

#: A page's response.
PAGE_JSON = f"""
    SELECT page_id, concat('{{"results":[', coalesce(items, ''), ']', {_MORE}, '}}') AS body
    FROM (SELECT p.*, o.want_layout, o.want_order, o.want_blocks FROM ({_PARTS}) p JOIN {{page_options}} o ON o.page_id = p.page_id)"""

#: Batches: a result for each slot in its order, and null or the error of each; a slot with an error has no results.
BATCH_JSON = f"""
    SELECT batch, concat('{{"batch_results":[', $COMMA(body, slot), '],"errors":[', $COMMA(error, slot), ']}}') AS body FROM (
      SELECT s.batch, s.slot, CASE WHEN s.error IS NOT NULL OR p.body IS NULL THEN '{{"results":[]}}' ELSE p.body END AS body, CASE WHEN s.error IS NULL THEN 'null' ELSE concat('"', s.error, '"') END AS error
      FROM {{batch_slots}} s LEFT JOIN ({PAGE_JSON}) p ON p.page_id = s.page_id)
    GROUP BY batch"""

#: Documents: each page with the mode in force, the quality of its text layer, and its size in points where nothing is rendered, else in pixels at the dpi asked for.
PDF_JSON = f"""
    SELECT doc, concat('{{"pages":[', $COMMA(page, page_index), ']}}') AS body FROM (
      SELECT doc, page_index, concat('{{"page":', page_index + 1, ',"page_index":', page_index, ',"dpi":', scale, ',"width":', CAST(round(width_pt * scale / 72.0D) AS INT), ',"height":', CAST(round(height_pt * scale / 72.0D) AS INT),
               ',"results":[', CASE WHEN resolved = 'geometric' AND quality <> 'trusted' THEN '' ELSE coalesce(items, '') END, ']', {_MORE}, ',"mode":"', resolved, '","text_layer_quality":"', quality, '"}}') AS page
      FROM (SELECT m.*, p.items, p.regions, p.ids, p.blocks, CASE WHEN render THEN m.dpi ELSE 72 END AS scale, m.layout AND render AS want_layout, m.layout AND resolved <> 'geometric' AS want_order, m.layout AND resolved <> 'geometric' AND m.as_blocks AS want_blocks
            FROM (SELECT r.*, CASE WHEN r.mode = 'ocr' THEN 'absent' ELSE q.quality END AS quality,
                         CASE WHEN r.mode = 'auto' THEN CASE WHEN q.quality = 'trusted' THEN 'geometric' ELSE 'ocr' END ELSE r.mode END AS resolved,
                         CASE WHEN r.mode IN ('ocr', 'auto_verified') THEN true WHEN r.mode = 'auto' AND q.quality <> 'trusted' THEN true ELSE r.layout END AS render
                  FROM {{pdf_requests}} r JOIN ({QUALITY}) q ON q.page_id = r.page_id) m
            LEFT JOIN ({_PARTS}) p ON p.page_id = m.page_id))
    GROUP BY doc"""

#: Numbers with five significant digits, as C prints them with %g.
NUMBER_FORMAT = "SELECT event_id, $G5(x) AS text FROM (SELECT event_id, event_id % 1000 / 8.0D AS x FROM {requests} UNION ALL SELECT event_id, event_id * 1000003.0D AS x FROM {requests} UNION ALL SELECT event_id, event_id / 1048576.0D / 1024 AS x FROM {requests})"

#: Strings as JSON, control characters included.
STRING_ESCAPE = "SELECT page_id, line_no, $QUOTE(t) AS quoted FROM (SELECT page_id, line_no, concat(text, chr(1 + CAST(line_no % 31 AS INT)), '\"', chr(92)) AS t FROM {lines})"

QUERIES = {"item_json": ITEM_JSON, "layout_json": LAYOUT_JSON, "block_json": BLOCK_JSON, "page_json": PAGE_JSON, "batch_json": BATCH_JSON, "pdf_json": PDF_JSON, "number_format": NUMBER_FORMAT, "string_escape": STRING_ESCAPE}
