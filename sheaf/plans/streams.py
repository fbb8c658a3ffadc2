"""Streams over the event table, run over all files that are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.plans.registry import query
from sheaf.session import shared_dir, table
from sheaf.streaming import reports


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.arriving(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events"))


@query("stream_search", "SELECT event_id, event_type, value FROM events WHERE event_type = 'error' AND value > 50")
def stream_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.search(_events(spark, sf_dir), (F.col("event_type") == "error") & (F.col("value") > 50))
    return reports.drained(found.select("event_id", "event_type", "value"), shared_dir(spark))


@query(
    "stream_report",
    "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:00:00') AS start, event_type, count(*)::BIGINT AS n, max(value) AS most FROM events WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY ALL",
)
def stream_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed windows: those that end before the watermark, a day behind the last event."""
    found = reports.drained(reports.report(_events(spark, sf_dir), ts="ts", key="event_type", value="value"), shared_dir(spark))
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "most")


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of user and type that occur; late repeats beyond the watermark meet in the batch distinct."""
    found = reports.dedupe(_events(spark, sf_dir).select("ts", "user_id", "event_type"), ts="ts", keys=["user_id", "event_type"])
    return reports.drained(found.select("user_id", "event_type"), shared_dir(spark)).distinct()
