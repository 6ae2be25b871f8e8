"""Arithmetic on boxes: flags, rescaling, crops, rotation, units. Sizes, turns and resolutions of pages come from {box_pages}."""

_WITH_PAGE = "FROM {boxes} b JOIN {box_pages} p ON p.page_id = b.page_id"

#: Taller than one and a half times its width, in whole numbers.
VERTICAL = "SELECT page_id, det_no, CAST(y1 - y0 AS BIGINT) * (y1 - y0) >= (CAST(x1 - x0 AS BIGINT) * (x1 - x0) * 225) DIV 100 AS is_vertical FROM {boxes}"

#: The box around a quad's four corners.
QUAD_BOX = """
    SELECT page_id, det_no, least(ax, bx, cx, dx) AS x0, least(ay, by_, cy, dy) AS y0, greatest(ax, bx, cx, dx) AS x1, greatest(ay, by_, cy, dy) AS y1,
           CAST(floor((ax + bx + cx + dx) * 0.25D * 100) AS BIGINT) AS centre_x100, (ay + by_ + cy + dy) DIV 4 AS centre_y FROM {quads}"""

#: A crop of height 48: upright or turned, and its width.
CROP = """
    SELECT page_id, det_no, turned, CAST(greatest(1, least(4000, ceil(48.0D * w / greatest(1, h)))) AS INT) AS crop_width FROM (
      SELECT page_id, det_no, (y1 - y0) >= 1.5D * (x1 - x0) AS turned, CASE WHEN (y1 - y0) >= 1.5D * (x1 - x0) THEN y1 - y0 ELSE x1 - x0 END AS w,
             CASE WHEN (y1 - y0) >= 1.5D * (x1 - x0) THEN x1 - x0 ELSE y1 - y0 END AS h FROM {boxes})"""

#: Coordinates of a detector's map back in the page, rounded and clamped; ratios have 32 bits.
RESCALE = f"""
    SELECT page_id, det_no, CAST(greatest(0, least(width - 1, round(x0 / rx))) AS INT) AS x0, CAST(greatest(0, least(height - 1, round(y0 / ry))) AS INT) AS y0,
           CAST(greatest(0, least(width - 1, round(x1 / rx))) AS INT) AS x1, CAST(greatest(0, least(height - 1, round(y1 / ry))) AS INT) AS y1
    FROM (SELECT b.*, p.width, p.height, CAST($FLOAT(p.map_width * 1.0D / p.width) AS DOUBLE) AS rx, CAST($FLOAT(p.map_height * 1.0D / p.height) AS DOUBLE) AS ry {_WITH_PAGE})"""

#: Size of the detector's input: longest side at most 960, sides to multiples of 32.
RESIZE = """
    SELECT image_id, width, height, CAST(greatest(32, round(width * ratio / 32) * 32) AS INT) AS in_w, CAST(greatest(32, round(height * ratio / 32) * 32) AS INT) AS in_h FROM (
      SELECT image_id, width, height, CASE WHEN greatest(width, height) > 960 THEN 960.0D / greatest(width, height) ELSE 1.0D END AS ratio FROM {images})"""

#: The recogniser's width: ceil(48 w / h) within 32 and 4000, raised to the next bucket.
WIDTH_BUCKET = """
    SELECT page_id, det_no, width, CASE WHEN width <= 320 THEN 320 WHEN width <= 480 THEN 480 WHEN width <= 800 THEN 800 WHEN width <= 1200 THEN 1200 WHEN width <= 1600 THEN 1600
      WHEN width <= 2000 THEN 2000 WHEN width <= 2500 THEN 2500 WHEN width <= 3200 THEN 3200 ELSE 4000 END AS bucket
    FROM (SELECT page_id, det_no, CAST(greatest(32, least(4000, ceil(48.0D * (x1 - x0) / (y1 - y0)))) AS INT) AS width FROM {boxes})"""

#: Boxes grown by area * 1.5 / perimeter on each side, rounded and clamped to the map.
UNCLIP = f"""
    SELECT page_id, det_no, CAST(greatest(0, round(x0 - d)) AS INT) AS x0, CAST(greatest(0, round(y0 - d)) AS INT) AS y0, CAST(least(map_width - 1, round(x1 + d)) AS INT) AS x1, CAST(least(map_height - 1, round(y1 + d)) AS INT) AS y1
    FROM (SELECT b.*, p.map_width, p.map_height, (b.x1 - b.x0) * (b.y1 - b.y0) * 1.5D / (2 * (b.x1 - b.x0 + b.y1 - b.y0)) AS d {_WITH_PAGE})"""

#: Opposite corners change places when the turned class wins with more than 0.9.
FLIP = """
    SELECT page_id, det_no, flipped, CASE WHEN flipped THEN x1 ELSE x0 END AS p0x, CASE WHEN flipped THEN y1 ELSE y0 END AS p0y, CASE WHEN flipped THEN x0 ELSE x1 END AS p2x, CASE WHEN flipped THEN y0 ELSE y1 END AS p2y
    FROM (SELECT *, score > 1 - score AND score > 0.9D AS flipped FROM {boxes})"""

_X = "CASE turn WHEN 0 THEN {0}x WHEN 90 THEN height - {0}y WHEN 180 THEN width - {0}x ELSE {0}y END"
_Y = "CASE turn WHEN 0 THEN height - {0}y WHEN 90 THEN width - {0}x WHEN 180 THEN {0}y ELSE {0}x END"

#: Boxes of a page in points, y upwards from the crop box's corner, as seen after the page's rotation, y downwards.
ROTATE = f"""
    SELECT page_id, det_no, turn, least({_X.format("p")}, {_X.format("q")}) AS x0, least({_Y.format("p")}, {_Y.format("q")}) AS y0, greatest({_X.format("p")}, {_X.format("q")}) AS x1, greatest({_Y.format("p")}, {_Y.format("q")}) AS y1
    FROM (SELECT b.page_id, b.det_no, p.turn, p.width, p.height, b.x0 - p.origin_x AS px, b.y0 - p.origin_y AS py, b.x1 - p.origin_x AS qx, b.y1 - p.origin_y AS qy {_WITH_PAGE})"""

#: Points to pixels at the page's resolution and back.
UNITS = f"SELECT b.page_id, b.det_no, CAST(round(b.x0 * p.dpi / 72.0D) AS INT) AS px, round(b.x0 * 72.0D / p.dpi, 6) AS pt {_WITH_PAGE}"

_PREVIOUS = "SELECT *, " + ", ".join(f"lag({c}) OVER (PARTITION BY page_id ORDER BY det_no) AS p{c}" for c in ("x0", "y0", "x1", "y1")) + " FROM {boxes}"

#: Manhattan distance of top-left corners to the box before, squared distance of the centre from the origin, sides and centre in whole numbers.
DISTANCES = f"""
    SELECT page_id, det_no, abs(x0 - px0) + abs(y0 - py0) AS manhattan, (x0 + x1) * (x0 + x1) * 0.25D + (y0 + y1) * (y0 + y1) * 0.25D AS centre_sq, least(x1 - x0, y1 - y0) AS short_side, (x0 + x1) DIV 2 AS cx, (y0 + y1) DIV 2 AS cy
    FROM ({_PREVIOUS})"""

#: Against the box before: overlap on the y axis over the union and over the shorter, and the gap between the nearest edges (0 on an axis that they share).
EDGES = f"""
    SELECT page_id, det_no, round(shared * 1.0D / (greatest(y1, py1) - least(y0, py0)), 9) AS overlap, round(shared * 1.0D / least(y1 - y0, py1 - py0), 9) AS overlap_small,
           CASE WHEN least(x1, px1) > greatest(x0, px0) THEN 0 ELSE least(abs(x0 - px1), abs(x1 - px0)) END + CASE WHEN least(y1, py1) > greatest(y0, py0) THEN 0 ELSE least(abs(y0 - py1), abs(y1 - py0)) END AS gap
    FROM (SELECT *, greatest(0, least(y1, py1) - greatest(y0, py0)) AS shared FROM ({_PREVIOUS})) WHERE px0 IS NOT NULL"""

#: How many cells one bin of a page's projection takes: the axis ends at the last box, and 4096 bins are the most.
PROJECTION_SCALE = "SELECT page_id, CASE WHEN end_x > 4096 THEN (end_x + 4095) DIV 4096 ELSE 1 END AS scale FROM (SELECT page_id, max(x1) * 7 AS end_x FROM {boxes} GROUP BY page_id)"

QUERIES = {
    "vertical_boxes": VERTICAL, "quad_box": QUAD_BOX, "crop_geometry": CROP, "box_rescale": RESCALE, "resize_dims": RESIZE, "width_bucket": WIDTH_BUCKET, "analytic_unclip": UNCLIP,
    "flip_180": FLIP, "page_rotation": ROTATE, "point_pixel": UNITS, "box_distances": DISTANCES, "edge_distances": EDGES, "projection_scale": PROJECTION_SCALE,
}
