"""Streaming queries, run over the stored tables as one available batch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from studyloom.plans.registry import query
from studyloom.sources.tables import _filesystem
from studyloom.session import ensure_checkpoint_dir, ship, table
from studyloom.streaming import counters as S


def _place(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _totals(spark, df, name: str):
    """All there is, through the streaming engine in complete mode into a table in memory: for a few result rows."""
    q = (
        df.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", _place(spark, name))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.table(name)


def _appended(spark, df, name: str):
    """All there is, in append mode into Parquet files of the shared folder."""
    out = _place(spark, f"{name}-rows")
    q = (
        df.writeStream.format("parquet").option("path", out).outputMode("append").option("checkpointLocation", _place(spark, name))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.parquet(out)


def _stream(spark, d, name: str):
    path = f"{d}/{name}.parquet"
    fs, p = _filesystem(spark, path)
    folder, glob = (path, "*.parquet") if fs.getFileStatus(p).isDirectory() else (d, f"{name}.parquet")
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", glob).parquet(folder)


@query("SELECT event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS value FROM events GROUP BY 1")
def stream_event_totals(spark, d):
    totals = _stream(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return _totals(spark, totals, "studyloom_event_totals").withColumn("value", F.round("value", 4))


@query("SELECT DISTINCT attempt_id, user_id FROM quiz_attempts")
def stream_delivered_once(spark, d):
    rows = _stream(spark, d, "quiz_attempts").withColumn("created_at", F.col("created_at").cast("timestamp"))
    once = S.delivered_once(rows, ["attempt_id"], "created_at", "400 days").select("attempt_id", "user_id")
    return _appended(spark, once, "studyloom_delivered_once")


@query("SELECT event_type, DATE_TRUNC('hour', ts) AS start, COUNT(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, d):
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.windowed(rows, "ts", "1 hour", "1 hour", "2 hours", "event_type").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query(
    """WITH RECURSIVE a AS (SELECT user_id, FLOOR(EPOCH(created_at))::BIGINT AS at_s FROM (SELECT DISTINCT * FROM quiz_attempts)), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY at_s) AS k FROM a),
f AS (SELECT user_id, k, at_s, TRUE AS ok, [at_s] AS kept FROM r WHERE k = 1
UNION ALL SELECT user_id, k, at_s, LEN(w) < 3, CASE WHEN LEN(w) < 3 THEN LIST_APPEND(w, at_s) ELSE w END FROM (SELECT r.user_id, r.k, r.at_s, LIST_FILTER(f.kept, lambda x: x > r.at_s - 86400) AS w FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1))
SELECT user_id, at_s, ok, COUNT(*) AS n FROM f GROUP BY ALL"""
)
def quota_admission(spark, d):
    """Admissions under a rolling limit, which only admitted requests use up: 3 a day here, so that the tables' users meet it (10 is the default)."""
    ship(spark)
    a = table(spark, d, "quiz_attempts").dropDuplicates(["attempt_id"])
    told = S.admitted_batch(a.select("user_id", F.unix_seconds(F.col("created_at").cast("timestamp")).alias("at_s")), limit=3)
    return told.groupBy("user_id", "at_s", "ok").agg(F.count(F.lit(1)).alias("n"))
