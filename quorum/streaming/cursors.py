"""How far each source has been read: cursors that are committed together with the rows read, and how far they may go."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.eventlog import LOG_KEY, _files, new_rows

#: A day without data may still be published while it is younger; then it is final.
HORIZON_DAYS = 4


def advanced(cursors: DataFrame, landed: DataFrame, today: Column, horizon_days: int = HORIZON_DAYS, most_days: int | None = None) -> DataFrame:
    """(source, cursor, first_gap, advance_to) from cursors (source, cursor: the last day taken) and the days landed (source, day).

    A cursor goes on to today, or most_days at most, but not past a missing day that is younger than the horizon: that is
    first_gap, and the day before it is the last that may be taken. Older missing days hold nothing up. So of each source
    only the days of the horizon are looked at, however long ago its cursor is. A cursor never goes back, nor does one that
    is already past today.
    """
    until = today if most_days is None else F.least(today, F.date_add("cursor", most_days))
    begin = F.greatest(F.date_add("cursor", 1), F.date_sub(today, horizon_days - 1))
    days = cursors.select("source", F.explode(F.when(begin <= until, F.sequence(begin, until))).alias("day"))
    gaps = days.join(landed.select("source", "day").distinct(), ["source", "day"], "left_anti").groupBy("source").agg(F.min("day").alias("first_gap"))
    held = cursors.select("source", "cursor").join(gaps, "source", "left")
    return held.withColumn("advance_to", F.greatest("cursor", F.coalesce(F.date_sub("first_gap", 1), until)))


def to_read(landed: DataFrame, plan: DataFrame, overlap_days: int = 0) -> DataFrame:
    """The rows of landed (source, day, ...) that a run takes by the plan of `advanced`: those after the cursor, and of overlap_days up to it once more."""
    near = plan.select("source", F.date_sub("cursor", overlap_days).alias("__after"), F.col("advance_to").alias("__upto"))
    return landed.join(near, "source").filter((F.col("day") > F.col("__after")) & (F.col("day") <= F.col("__upto"))).drop("__after", "__upto")


def _commits(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(place, batch) of what is committed, in order."""
    fs, at = _files(spark, root)
    if not fs.exists(at(f"{root}/commits")):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at(f"{root}/commits"))]
    return sorted((int(n.split(".", 1)[0]), n.split(".", 1)[1]) for n in names if n[:1].isdigit())


def committed_rows(spark: SparkSession, root: str, schema) -> DataFrame:
    """All rows of committed batches; what a batch that died has written isn't among them."""
    found = [f"{root}/rows/batch={b}" for _, b in _commits(spark, root)]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def committed_cursors(spark: SparkSession, root: str) -> DataFrame:
    """(source, cursor) as of the last committed batch."""
    done = _commits(spark, root)
    if not done:
        return spark.createDataFrame([], "source string, cursor string")
    return spark.read.schema("source string, cursor string").parquet(f"{root}/cursors/batch={done[-1][1]}")


def _put_rows(batch: DataFrame, number: str, root: str, keys: list[str]) -> None:
    log = committed_rows(batch.sparkSession, root, batch.schema)
    log = log.join(F.broadcast(batch.select("source").distinct()), "source", "left_semi")  # a source's name per kind of files, so few
    new_rows(batch, log, keys).write.mode("overwrite").parquet(f"{root}/rows/batch={number}")


def _put_cursors(batch: DataFrame, number: str, root: str, cursor: Column) -> None:
    seen = batch.groupBy("source").agg(F.max(cursor.cast("string")).alias("cursor"))
    both = committed_cursors(batch.sparkSession, root).unionByName(seen)
    both.groupBy("source").agg(F.max("cursor").alias("cursor")).coalesce(1).write.mode("overwrite").parquet(f"{root}/cursors/batch={number}")


def _commit(spark: SparkSession, number: str, root: str) -> None:
    fs, at = _files(spark, root)
    done = _commits(spark, root)
    fs.mkdirs(at(f"{root}/commits"))
    fs.createNewFile(at(f"{root}/commits/{(done[-1][0] if done else 0) + 1:012d}.{number}"))


def commit_batch(batch: DataFrame, number: str, root: str, cursor: Column, keys: list[str] = LOG_KEY) -> bool:
    """Adds to the log under root the rows of batch that it doesn't have, and moves the cursors of its sources; whether it did.

    number names the batch. Rows and cursors are written under that name, over what an earlier try has left, and count once
    the file commits/{place}.{number} is there, which is written last. So they appear together or not at all, and a batch
    that is committed isn't written again. cursor is a text that grows with what has been read; the new ones hold all
    sources, each the greater of its own and the batch's. One writer at a time.
    """
    spark = batch.sparkSession
    if number in {b for _, b in _commits(spark, root)}:
        return False
    _put_rows(batch, number, root, keys)
    _put_cursors(batch, number, root, cursor)
    _commit(spark, number, root)
    return True


def append_committed(events: DataFrame, root: str, checkpoint: str, cursor: Column, keys: list[str] = LOG_KEY):
    """A stream of rows (source, ...) to the log under root, rows and cursors of each micro-batch committed together.

    A batch is named by the stream's own id, which its checkpoint keeps, and the batch's number, so a restarted stream
    repeats the batch that it died in under the same name, and one that begins anew doesn't take another's.
    """
    spark = events.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        stream = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        kept = batch.persist()
        commit_batch(kept, f"{stream}-{number}", root, cursor, keys)
        kept.unpersist()

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
