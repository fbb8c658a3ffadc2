"""Searches, reports and deduplication over files that keep arriving.

State is bounded by a watermark on ``ts``.  ``drained`` runs a query over all that is there now
into Parquet in a shared folder, which is how a batch caller or a test sees a stream's result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, folder: str, like: DataFrame, files_per_step: int = 4) -> DataFrame:
    """New Parquet files of ``folder`` (a glob will do) with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_step).parquet(folder)


def search(rows: DataFrame, hit: Column) -> DataFrame:
    return rows.filter(hit)


def report(events: DataFrame, *, ts: str, key: str, value: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Count and greatest value per window and key, once the watermark has passed the window."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    grouped = timed.groupBy(F.window(ts, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("most"))
    return grouped.select(F.col("w.start").alias("start"), key, "n", "most")


def dedupe(events: DataFrame, *, ts: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def changed(rows: DataFrame, seen: DataFrame, key: str, content: str) -> DataFrame:
    """Rows whose content hash is not the one that ``seen`` (key, digest) holds."""
    hashed = rows.withColumn("digest", F.sha2(F.col(content), 256))
    return hashed.join(seen.select(key, "digest"), [key, "digest"], "left_anti")


def drained(stream: DataFrame, shared: str, mode: str = "append") -> DataFrame:
    spark, name = stream.sparkSession, uuid.uuid4().hex
    out = f"{shared.rstrip('/')}/stream-{name}"
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
