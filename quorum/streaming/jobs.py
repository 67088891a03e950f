"""Structured Streaming: the log's deduplication and its daily and sliding aggregates, over files that keep arriving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.eventlog import append_events
from ..operators.grids import weighted

#: Facts may be this late: what is older than the newest by more is final.
LATENESS = "4 days"


def event_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def deduplicated(events: DataFrame, keys: list[str], at: str = "occurred_at", lateness: str = LATENESS) -> DataFrame:
    """The first row of each key; state is kept for as long as a fact may be late."""
    return events.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)


def daily(events: DataFrame, entity: str, at: str, weights: dict[str, float], kind: str = "event_type", lateness: str = LATENESS) -> DataFrame:
    """Tumbling days: each entity's weighted intensity and count."""
    seen = events.withWatermark(at, lateness)
    return seen.groupBy(F.window(at, "1 day"), entity).agg(F.sum(weighted(F.col(kind), weights)).alias("intensity"), F.count("*").alias("cnt")).select(entity, F.to_date("window.start").alias("day"), "intensity", "cnt")


def sliding(events: DataFrame, at: str, width: str = "7 days", step: str = "1 day", lateness: str = LATENESS) -> DataFrame:
    """Counts of the last width, every step."""
    return events.withWatermark(at, lateness).groupBy(F.window(at, width, step)).agg(F.count("*").alias("cnt")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "cnt")


def sessions(events: DataFrame, entity: str, at: str, gap: str | Column = "6 hours", lateness: str = LATENESS) -> DataFrame:
    """Runs of an entity's events with less than gap between neighbours."""
    seen = events.withWatermark(at, lateness)
    return seen.groupBy(F.session_window(at, gap), entity).agg(F.count("*").alias("cnt")).select(entity, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "cnt")


def append_log(events: DataFrame, log: str, checkpoint: str):
    """Each batch adds to the log at a path what it doesn't have; the offsets are committed after the rows are written, so a repeated batch adds nothing."""
    return events.writeStream.foreachBatch(lambda batch, _: append_events(batch, log)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
