"""The change feed: pending events, coalescing, a one-shot drain and the verification state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import shared_path


def pending(events: DataFrame, acks: DataFrame) -> DataFrame:
    """Events not acknowledged, once each."""
    return events.dropDuplicates(["event_id"]).join(acks.select("event_id").distinct(), "event_id", "left_anti")


def coalesced(events: DataFrame) -> DataFrame:
    """path, events, last of the pending work: one row a file, whatever the number of its events."""
    return events.groupBy("path").agg(F.count("*").alias("events"), F.max("ts").alias("last"))


def drain(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """Everything in the feed now, deduplicated by event_id; each batch is appended under its number, so a repeat changes nothing."""
    out, mark = shared_path(spark, "drained"), shared_path(spark, "progress")
    feed = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).dropDuplicates(["event_id"])

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    feed.writeStream.foreachBatch(add).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(out).select(*schema.fieldNames())


def stale(events: DataFrame, indexed: DataFrame) -> DataFrame:
    """path, ts of files changed after they were indexed (path, indexed_at), or unknown and newer than the watermark, the newest indexed_at."""
    mark = indexed.agg(F.max("indexed_at").alias("mark"))
    last = events.groupBy("path").agg(F.max("ts").alias("ts")).join(indexed, "path", "left").crossJoin(F.broadcast(mark))  # mark is one row
    return last.filter((F.col("ts") > F.col("indexed_at")) | (F.col("indexed_at").isNull() & (F.col("mark").isNull() | (F.col("ts") > F.col("mark"))))).select("path", "ts")


def verification(events: DataFrame) -> DataFrame:
    """project, edits, verified, clean: the edit generation, the one last verified, and whether nothing was edited since."""
    by = Window.partitionBy("project").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    edits = F.sum((F.col("kind") == "edit").cast("long")).over(by)
    seen = events.withColumn("generation", edits).withColumn("checked", F.when(F.col("kind") == "verify", F.col("generation")))
    folded = seen.groupBy("project").agg(F.max("generation").alias("edits"), F.coalesce(F.max("checked"), F.lit(-1)).alias("verified"))
    return folded.withColumn("clean", F.col("edits") == F.col("verified"))
