"""PDF text layers: whether to trust them, how a page is then read, and native text in place of recognised text."""

#: absent, rejected or trusted; the order of the tests matters.
QUALITY = """
    SELECT page_id, CASE WHEN char_count = 0 THEN 'absent' WHEN rotation_deg <> 0 THEN 'rejected' WHEN char_count < 10 THEN 'absent'
      WHEN fffd_count * 20 > char_count THEN 'rejected' WHEN nonprint_count * 10 > char_count THEN 'rejected' WHEN NOT has_lines THEN 'absent' ELSE 'trusted' END AS quality
    FROM {text_pages}"""

#: Counters of a page's text layer from its lines: characters, broken ones, unprintable ones, whether there is a line.
COUNTERS = """
    SELECT page_id, CAST(sum(length(text)) AS BIGINT) AS char_count, CAST(sum(length(text) - length(replace(text, '�', ''))) AS BIGINT) AS fffd_count, CAST(sum($NONPRINT(text)) AS BIGINT) AS nonprint_count, count(*) > 0 AS has_lines
    FROM {native_lines} GROUP BY page_id"""

# Native lines whose centre lies in an item's box, in points: the box is in pixels of the page's resolution.
_NATIVE = """
    SELECT i.page_id, i.line_no, max(i.x1 - i.x0) * 72.0D / max(p.dpi) AS w, $SPACED(n.text, n.k) AS text
    FROM {items} i JOIN {item_pages} p ON p.page_id = i.page_id JOIN {native_lines} n ON n.page_id = i.page_id
      AND (n.x0 + n.x1) / 2.0D BETWEEN i.x0 * 72.0D / p.dpi AND i.x1 * 72.0D / p.dpi AND (n.y0 + n.y1) / 2.0D BETWEEN i.y0 * 72.0D / p.dpi AND i.y1 * 72.0D / p.dpi
    GROUP BY i.page_id, i.line_no"""

#: Whether native text fits its box: not empty, few broken characters, a plausible number of characters for the width in points.
SANITY = f"""
    SELECT page_id, line_no, text, n, n > 0 AND fffd * 20 <= n AND nonprint * 10 <= n AND n >= 0.5D * w / 30 AND n <= 2.0D * w / 2 AS accepted FROM (
      SELECT page_id, line_no, text, length(text) AS n, w, length(text) - length(replace(text, '�', '')) AS fffd,
             $NONPRINT(text) AS nonprint FROM ({_NATIVE}))"""

#: Recognised text gives way to native text in its box that passes SANITY, with full confidence.
VERIFIED_TEXT = f"""
    SELECT i.page_id, i.line_no, CASE WHEN s.accepted THEN s.text ELSE i.text END AS text, CASE WHEN s.accepted THEN 'pdf' ELSE i.source END AS source, CASE WHEN s.accepted THEN 1.0D ELSE i.confidence END AS confidence
    FROM {{items}} i LEFT JOIN ({SANITY}) s ON s.page_id = i.page_id AND s.line_no = i.line_no"""

#: For each requested mode, page and layout flag: the mode in force, where text comes from, whether to render.
MODE_MATRIX = f"""
    SELECT q.page_id, m.mode, l.layout, CASE WHEN m.mode = 'ocr' THEN 'absent' ELSE q.quality END AS quality,
      CASE WHEN m.mode = 'ocr' THEN 'ocr' WHEN m.mode = 'geometric' THEN 'geometric' WHEN m.mode = 'auto_verified' THEN 'auto_verified'
           WHEN q.quality = 'trusted' THEN 'geometric' ELSE 'ocr' END AS resolved,
      CASE WHEN m.mode = 'ocr' THEN 'ocr' WHEN m.mode = 'geometric' THEN CASE WHEN q.quality = 'trusted' THEN 'native' ELSE 'none' END
           WHEN m.mode = 'auto_verified' THEN 'overlay' WHEN q.quality = 'trusted' THEN 'native' ELSE 'ocr' END AS text_source,
      CASE WHEN m.mode IN ('ocr', 'auto_verified') THEN true WHEN m.mode = 'auto' AND q.quality <> 'trusted' THEN true ELSE l.layout END AS render
    FROM ({QUALITY}) q CROSS JOIN (VALUES ('ocr'), ('geometric'), ('auto'), ('auto_verified')) AS m(mode) CROSS JOIN (VALUES (true), (false)) AS l(layout)"""

#: Trailing space, tab, carriage return and line feed go.
TRIMMED = "SELECT page_id, line_no, $RTRIM(text, concat(' ', chr(9), chr(13), chr(10)))$ AS text FROM {padded_lines}"

#: Lower case, white space collapsed to one space and trimmed.
SQUEEZED = "SELECT page_id, line_no, $SQUEEZE(text) AS text FROM {padded_lines}"

#: Native text inside a rectangle: lines whose centre lies in it, from top to bottom.
TEXT_IN_RECT = """
    SELECT page_id, lid, $JOIN(part, line_no) AS text FROM (
      SELECT r.page_id, r.lid, i.line_no, concat(i.text, chr(10)) AS part FROM {regions} r JOIN {items} i ON i.page_id = r.page_id
        AND (i.x0 + i.x1) / 2.0D BETWEEN r.x0 AND r.x1 AND (i.y0 + i.y1) / 2.0D BETWEEN r.y0 AND r.y1)
    GROUP BY page_id, lid"""

QUERIES = {
    "text_in_rect": TEXT_IN_RECT, "text_layer_quality": QUALITY, "text_layer_counters": COUNTERS, "native_text_sanity": SANITY, "verified_text": VERIFIED_TEXT, "pdf_mode_matrix": MODE_MATRIX,
    "trailing_trim": TRIMMED, "normalised_space": SQUEEZED,
}
