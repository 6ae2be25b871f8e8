"""Requests: routes, option parsing with error codes, body checks, counters, histograms, percentiles."""

# Upper bounds of the latency histogram, in seconds.
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 5.0)
# Routes that are counted by name; any other path counts as the last.
ROUTES = ("/ocr", "/ocr/raw", "/ocr/batch", "/ocr/pixels", "/ocr/pdf", "/health")
# Most pixels of a side, most pages of a document.
MOST_SIDE, MOST_PAGES = 16384, 2000
# Error codes and the HTTP status of each.
ERROR_STATUS = {
    "BASE64_DECODE_FAILED": 400, "BODY_SIZE_MISMATCH": 400, "DIMENSIONS_TOO_LARGE": 400, "EMPTY_BATCH": 400, "EMPTY_BODY": 400, "EMPTY_PDF": 400, "IMAGE_DECODE_FAILED": 400,
    "INVALID_DIMENSIONS": 400, "INVALID_DPI": 400, "INVALID_HEADER": 400, "INVALID_JSON": 400, "INVALID_MULTIPART": 400, "INVALID_PARAMETER": 400, "LAYOUT_DISABLED": 400,
    "MISSING_FILE": 400, "MISSING_HEADER": 400, "MISSING_IMAGE": 400, "MISSING_PDF": 400, "PDF_RENDER_FAILED": 400, "PDF_TOO_LARGE": 400, "INFERENCE_ERROR": 500, "NOT_READY": 503, "SERVER_BUSY": 503,
}

_ROUTE = f"CASE WHEN path IN ({', '.join(repr(r) for r in ROUTES[:-1])}) THEN path ELSE '{ROUTES[-1]}' END"

#: Calls with their route.
ROUTED = f"SELECT event_id, user_id, {_ROUTE} AS route, status, duration_s, bytes, arrival FROM {{calls}}"


def _flag(column: str) -> str:
    """true, false, or null for what is no boolean."""
    return f"CASE WHEN lower({column}) IN ('1', 'true', 'on', 'yes') THEN true WHEN lower({column}) IN ('', '0', 'false', 'off', 'no') THEN false END"


#: Parsed options with implications and the first error code that applies.
VALIDATE = f"""
    SELECT layout, reading_order, as_blocks, mode, dpi, available,
      CASE WHEN mode IN ('ocr', 'geometric', 'auto', 'auto_verified') THEN mode ELSE 'ocr' END AS parsed_mode,
      CASE WHEN l IS NULL OR r IS NULL OR b IS NULL THEN 'INVALID_PARAMETER' WHEN l AND NOT available THEN 'INVALID_PARAMETER'
           WHEN (r OR b) AND NOT available THEN 'LAYOUT_DISABLED' WHEN dpi < 50 OR dpi > 600 THEN 'INVALID_DPI' END AS error_code,
      coalesce(l, false) OR coalesce(r, false) OR coalesce(b, false) AS want_layout, coalesce(r, false) OR coalesce(b, false) AS want_order, coalesce(b, false) AS want_blocks
    FROM (SELECT *, {_flag("layout")} AS l, {_flag("reading_order")} AS r, {_flag("as_blocks")} AS b FROM {{options}})"""

_BUCKETS = ", ".join(f"count_if(duration_s <= {b}D AND duration_s > {a}D) AS le_{i}" for i, (a, b) in enumerate(zip((-1.0, *BOUNDS), BOUNDS, strict=False)))

#: Counters by route: status classes, histogram, sum in whole microseconds, count, bytes.
METRICS = f"""
    SELECT route, count_if(status DIV 100 = 2) AS ok, count_if(status DIV 100 = 4) AS client_error, count_if(status DIV 100 = 5) AS server_error,
           {_BUCKETS}, sum(CAST(floor(duration_s * 1000000) AS BIGINT)) AS sum_us, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes
    FROM {{requests}} GROUP BY route"""


def _exposition() -> str:
    """Lines of the text exposition from one aggregate: each route's counters meet the kinds of line (a fixed handful)."""
    count = lambda k, status, column: f"WHEN k = {k} THEN concat('requests_total{{{{route=\"', route, '\",status=\"{status}\"}}}} ', {column})"
    bucket = lambda k, le, sum_: f"WHEN k = {k} THEN concat('request_duration_seconds_bucket{{{{route=\"', route, '\",le=\"{le}\"}}}} ', {sum_})"
    seconds = "concat(CAST(sum_us AS BIGINT) DIV 1000000, '.', lpad(CAST(CAST(sum_us AS BIGINT) % 1000000 AS STRING), 6, '0'))"
    kinds = [count(k, s, c) for k, (s, c) in enumerate((("2xx", "ok"), ("4xx", "client_error"), ("5xx", "server_error")))]
    kinds += [bucket(3 + i, f"{b:.3f}", " + ".join(f"le_{j}" for j in range(i + 1))) for i, b in enumerate(BOUNDS)]
    kinds += [bucket(12, "+Inf", "n"), f"WHEN k = 13 THEN concat('request_duration_seconds_sum{{{{route=\"', route, '\"}}}} ', {seconds})", "WHEN k = 14 THEN concat('request_duration_seconds_count{{route=\"', route, '\"}} ', n)"]
    return f"""
    SELECT line FROM (SELECT route, k, CASE {" ".join(kinds)} END AS line FROM ({METRICS}) CROSS JOIN (VALUES {", ".join(f"({k})" for k in range(15))}) AS v(k)) WHERE k < 3 OR route <> '{ROUTES[-1]}'
    UNION ALL
    SELECT CASE k WHEN 0 THEN concat('request_bytes_total ', total) ELSE concat('request_body_avg_bytes ', CAST(round(total * 1.0D / greatest(1, n)) AS BIGINT)) END AS line
    FROM (SELECT coalesce(CAST(sum(bytes) AS BIGINT), 0) AS total, count(*) AS n FROM {{requests}}) CROSS JOIN (VALUES (0), (1)) AS v(k)
    UNION ALL
    SELECT line FROM (VALUES ('# TYPE requests_total counter'), ('# TYPE request_duration_seconds histogram'), ('# TYPE request_bytes_total counter'), ('# TYPE request_body_avg_bytes gauge'),
      ('# HELP requests_total Requests by route and status.'), ('# HELP request_duration_seconds Latency of requests.'), ('# HELP request_bytes_total Bytes of request bodies.'), ('# HELP request_body_avg_bytes Mean size of a body.')) AS v(line)"""


#: The lines of the text exposition: counters, cumulative buckets without the health route, sums and counts, sizes.
EXPOSITION = _exposition()

#: Mean size of a route's requests.
SIZE = "SELECT route, CAST(sum(bytes) AS BIGINT) AS total, count(*) AS n, round(CAST(sum(bytes) AS DOUBLE) / count(*), 9) AS mean_bytes FROM {requests} GROUP BY route"

_VALUES = "SELECT route, duration_s, CAST(floor(duration_s * 100) AS BIGINT) AS bucket, count(*) AS n FROM {requests} GROUP BY route, duration_s"
_RANKS = " UNION ALL ".join(f"SELECT route, total, '{name}' AS q, {index} AS rank FROM ends" for name, index in (("p50", "floor(total * 0.5D)"), ("p95", "floor(total * 0.95D)"), ("p99", "least(total - 1, floor(total * 0.99D))")))

#: Order statistics at int(n * q), the last one clamped. Equal values are counted before the shuffle; buckets of a hundredth give the one that holds the rank, whose values alone are ordered.
PERCENTILES = f"""
    WITH each AS ({_VALUES}),
    sized AS (SELECT route, bucket, sum(n) AS n FROM each GROUP BY route, bucket),
    spread AS (SELECT route, bucket, n, sum(n) OVER (PARTITION BY route ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM sized),
    ends AS (SELECT route, CAST(max(upto) AS BIGINT) AS total FROM spread GROUP BY route),
    wanted AS ({_RANKS}),
    chosen AS (SELECT w.route, w.total, w.q, s.bucket, w.rank - (s.upto - s.n) AS place FROM wanted w JOIN spread s ON s.route = w.route WHERE s.upto > w.rank AND s.upto - s.n <= w.rank),
    near AS (SELECT c.route, c.total, c.q, c.place, e.duration_s, sum(e.n) OVER (PARTITION BY c.route, c.q ORDER BY e.duration_s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
             FROM chosen c JOIN each e ON e.route = c.route AND e.bucket = c.bucket)
    SELECT route, total AS n, min(CASE WHEN q = 'p50' AND upto > place THEN duration_s END) AS p50, min(CASE WHEN q = 'p95' AND upto > place THEN duration_s END) AS p95, min(CASE WHEN q = 'p99' AND upto > place THEN duration_s END) AS p99
    FROM near GROUP BY route, total"""

#: Raw pixel requests by their headers and body: missing sizes, sizes that are no numbers, bad sizes or channels (3 if not given), too large, body of another length.
PIXELS = f"""
    SELECT event_id, CASE WHEN x_width = '' OR x_height = '' THEN 'MISSING_HEADER' WHEN w IS NULL OR h IS NULL OR c IS NULL THEN 'INVALID_HEADER' WHEN w <= 0 OR h <= 0 OR c NOT IN (1, 3) THEN 'INVALID_DIMENSIONS'
      WHEN w > {MOST_SIDE} OR h > {MOST_SIDE} THEN 'DIMENSIONS_TOO_LARGE' WHEN body_bytes <> w * h * c THEN 'BODY_SIZE_MISMATCH' END AS error_code
    FROM (SELECT *, $INTEGER(x_width) AS w, $INTEGER(x_height) AS h, CASE WHEN x_channels = '' THEN 3 ELSE $INTEGER(x_channels) END AS c FROM {{pixel_bodies}})"""

#: Images by the size that their header tells: too large if a side is.
IMAGE_SIZE = f"SELECT image_id, width, height, CASE WHEN width > {MOST_SIDE} OR height > {MOST_SIDE} THEN 'DIMENSIONS_TOO_LARGE' END AS error_code FROM {{images}}"

#: Documents with more than 2000 pages are too large.
PAGE_LIMIT = f"SELECT doc, count(*) AS pages, CASE WHEN count(*) > {MOST_PAGES} THEN 'PDF_TOO_LARGE' END AS error_code FROM {{pdf_requests}} GROUP BY doc"

_STATUS = "CASE code " + " ".join(f"WHEN '{c}' THEN {s}" for c, s in ERROR_STATUS.items()) + " ELSE 500 END"

#: The structured error of a failed request, and its status.
ERRORS = f"""
    SELECT event_id, code, {_STATUS} AS status, concat('{{"error":{{"code":', $QUOTE(code), ',"message":', $QUOTE(message), '}}}}') AS body FROM {{failures}}"""

QUERIES = {
    "route_from_path": ROUTED, "validate_requests": VALIDATE, "request_metrics": METRICS, "metrics_exposition": EXPOSITION, "request_size": SIZE, "latency_percentiles": PERCENTILES,
    "pixel_requests": PIXELS, "image_size": IMAGE_SIZE, "page_limit": PAGE_LIMIT, "error_envelope": ERRORS,
}
