"""Streams give what the bounded table gives."""

import random

from pyspark.sql import functions as F

from quirework.plans.views import spark_view
from quirework.streaming.requests import rate_limit, rate_limit_stream, running_counters


def _stream(spark, df, path):
    df.repartition(3).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_counters(spark, sf_dir, tmp_path):
    requests = spark_view(spark, sf_dir, "requests", {}).select("route", "status", "bytes")
    query = running_counters(_stream(spark, requests, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("counters").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(spark.table("counters").collect()) == sorted(running_counters(requests).collect())


def test_rate_limit_in_one_batch(spark, sf_dir, tmp_path):
    calls = spark_view(spark, sf_dir, "requests", {}).select("event_id", F.lit("a").alias("site"), (F.col("event_id") * 13).alias("at")).coalesce(1)
    calls.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in"))
    query = rate_limit_stream(source).writeStream.outputMode("append").format("memory").queryName("limited").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(spark.table("limited").collect()) == sorted(rate_limit(calls).collect())


def test_rate_limit_over_batches_and_sites(spark):
    """Windows stay open from one Arrow batch to the next; a null site is a site."""
    pick = random.Random(5)
    rows = [(i, pick.choice(["a", "a", "a", "b", None]), pick.randint(0, 60)) for i in range(300)]
    want = []
    for site in ("a", "b", None):
        own = sorted((at, i) for i, s, at in rows if s == site)
        start, seen = None, 0
        for at, i in own:
            held = 0
            if start is None or at - start >= 10:
                held, start, seen = max(0, seen - 4), at, 0
            seen += 1
            want.append((i, site, seen <= 4, held))
    calls = spark.createDataFrame(rows, "event_id bigint, site string, at bigint")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(tuple(r) for r in rate_limit(calls, 4, 10).collect()) == sorted(want)
        assert rate_limit(calls.where("false")).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
