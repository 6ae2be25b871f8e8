"""Request counters and event-anchored rate limits over streams; both also run on a bounded table."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.plans.views import duck_query, spark_view

#: Calls that pass in a window, and its length.
PASS, WINDOW_MS = 10, 1000


def running_counters(requests: DataFrame) -> DataFrame:
    """Counts by route: of a table, or of a stream in update or complete mode."""
    return requests.groupBy("route").agg(F.count("*").alias("n"), F.count_if(F.col("status") >= 500).alias("server_errors"), F.sum("bytes").alias("bytes"))


def limit_calls(times: list[int], state: tuple[int, int] | None, passes: int, window: int) -> tuple[list[tuple[int, bool, int]], tuple[int, int]]:
    """(time, passed, calls held back in the window before) for times in order. A window opens at its first call."""
    start, seen = state or (None, 0)
    out = []
    for t in times:
        held = 0
        if start is None or t - start >= window:
            held, start, seen = max(0, seen - passes), t, 0
        seen += 1
        out.append((t, seen <= passes, held))
    return out, (start, seen)


def rate_limit(calls: DataFrame, passes: int = PASS, window_ms: int = WINDOW_MS) -> DataFrame:
    """site, at (ms) of a bounded table -> with passed and held_back.

    Sites are dealt whole and sorted by Spark, which spills; a task walks its
    calls batch by batch and keeps only the window that is open, so a site of
    any size fits. A null site is one of its own.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple | None = None
        state = None
        for pdf in batches:
            sites = pdf["site"].astype(object).where(pdf["site"].notna(), None).tolist()
            rows: list[tuple[int, bool, int]] = []
            for site, own in itertools.groupby(zip(sites, pdf["at"].tolist(), strict=True), key=itemgetter(0)):
                found, state = limit_calls([at for _, at in own], state if (site,) == last else None, passes, window_ms)
                last = (site,)
                rows += found
            yield pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "site": sites, "passed": [r[1] for r in rows], "held_back": [r[2] for r in rows]})

    dealt = calls.select("event_id", "site", "at").repartition("site").sortWithinPartitions("site", "at", "event_id")
    return dealt.mapInPandas(walk, "event_id bigint, site string, passed boolean, held_back bigint")


def rate_limit_stream(calls: DataFrame, passes: int = PASS, window_ms: int = WINDOW_MS) -> DataFrame:
    """As rate_limit, over a stream: the window of each site is state that outlives a batch."""

    def site(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else None
        pdf = pd.concat(list(batches)).sort_values(["at", "event_id"])
        rows, new = limit_calls(pdf["at"].tolist(), now, passes, window_ms)
        state.update(new)
        yield pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "site": key[0], "passed": [r[1] for r in rows], "held_back": [r[2] for r in rows]})

    return calls.groupBy("site").applyInPandasWithState(site, "event_id bigint, site string, passed boolean, held_back bigint", "start bigint, seen int", "append", "NoTimeout")


def _counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running_counters(spark_view(spark, sf_dir, "requests", {}))


def _limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = spark_view(spark, sf_dir, "requests", {}).select("event_id", F.concat_ws("", F.lit("site"), F.col("event_id") % 7).alias("site"), (F.col("event_id") * 13).alias("at"))
    return rate_limit(calls)


QUERIES = {"stream_metrics": _counters, "rate_limit": _limited}
_CALLS = "SELECT event_id, concat('site', CAST(event_id % 7 AS STRING)) AS site, event_id * 13 AS moment FROM {requests}"

ORACLES = {
    "stream_metrics": duck_query("SELECT route, count(*) AS n, count_if(status >= 500) AS server_errors, CAST(sum(bytes) AS BIGINT) AS bytes FROM {requests} GROUP BY route"),
    # one call after the other of each site, with the window's start and the calls seen in it
    "rate_limit": f"""
        WITH RECURSIVE o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY site ORDER BY moment, event_id) AS k FROM ({duck_query(_CALLS)})),
        f AS (SELECT event_id, site, k, moment AS start, 1 AS seen, 0 AS held FROM o WHERE k = 1
              UNION ALL
              SELECT o.event_id, o.site, o.k, CASE WHEN o.moment - f.start >= {WINDOW_MS} THEN o.moment ELSE f.start END, CASE WHEN o.moment - f.start >= {WINDOW_MS} THEN 1 ELSE f.seen + 1 END,
                     CASE WHEN o.moment - f.start >= {WINDOW_MS} THEN greatest(0, f.seen - {PASS}) ELSE 0 END
              FROM f JOIN o ON o.site = f.site AND o.k = f.k + 1)
        SELECT event_id, site, seen <= {PASS} AS passed, CAST(held AS BIGINT) AS held_back FROM f""",
}
