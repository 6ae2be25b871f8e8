"""What follows detection and recognition models: CTC decoding, gates, joining boxes with texts."""

_ARGMAX = "SELECT page_id, step, CAST($ARGMAX(scores) AS INT) AS best, CAST($MAX(scores) AS DOUBLE) AS score FROM {steps}"

#: Greedy CTC: the best class of each step, repeats and blanks (0) dropped; confidence is the mean of what stays, 0 if nothing.
CTC_DECODE = f"""
    SELECT page_id, coalesce($JOIN(letter, step), '') AS text, round(coalesce(avg(kept), 0.0D), 9) AS confidence FROM (
      SELECT page_id, step, CASE WHEN keep THEN chr(96 + best) END AS letter, CASE WHEN keep THEN score END AS kept FROM (
        SELECT *, best <> 0 AND best <> coalesce(lag(best) OVER (PARTITION BY page_id ORDER BY step), -1) AS keep FROM ({_ARGMAX})))
    GROUP BY page_id"""

#: Items of confidence 0.5 and more with a text.
DROP_SCORE = "SELECT page_id, line_no, text, confidence FROM {items} WHERE confidence >= 0.5 AND text <> ''"

#: Boxes joined with recognised texts by position in the page.
RECOGNITION_ZIP = """
    SELECT b.page_id, b.det_no, i.text, i.confidence FROM {boxes} b JOIN (
      SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY line_no) - 1 AS k, text, confidence FROM {items}) i
    ON i.page_id = b.page_id AND i.k = b.det_no"""

#: Probabilities over 0.3, as counts of foreground cells in each row of the map.
BINARISE = "SELECT page_id, step, $OVER(scores, 0.3D) AS foreground FROM {steps}"

#: Boxes that pass the size and score gates of contours: sides of 3 and more, score 0.6, and sides over 3 after scaling back.
CONTOUR_GATE = """
    SELECT page_id, det_no, score FROM (
      SELECT page_id, det_no, score, x1 - x0 AS w, y1 - y0 AS h, row_number() OVER (PARTITION BY page_id ORDER BY det_no) AS k FROM {boxes})
    WHERE k <= 1000 AND w >= 3 AND h >= 3 AND least(w, h) >= 5 AND score >= 0.6 AND floor(w / 1.5D) > 3 AND floor(h / 1.5D) > 3"""

#: At most 300 layout rows a page, in the order of detection.
DETECTION_CAP = "SELECT page_id, det_no FROM (SELECT page_id, det_no, row_number() OVER (PARTITION BY page_id ORDER BY det_no) AS k FROM {boxes}) WHERE k <= 300"

QUERIES = {"ctc_decode": CTC_DECODE, "drop_score": DROP_SCORE, "recognition_zip": RECOGNITION_ZIP, "binarise": BINARISE, "contour_gate": CONTOUR_GATE, "detection_cap": DETECTION_CAP}
