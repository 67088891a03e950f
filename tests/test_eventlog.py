from pyspark.sql import functions as F

from quorum.operators import eventlog as log
from quorum.operators.grids import banded, thresholds
from quorum.streaming import jobs

ROW = "source string, source_id string, payload_hash string, occurred_at timestamp"


def batch(spark, *rows):
    return spark.createDataFrame([(*r, None) for r in rows], ROW).withColumn("occurred_at", F.to_timestamp(F.lit("2025-01-02 03:04:05")))


def test_append_is_idempotent(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = batch(spark, ("s", "1", "A"), ("s", "2", "B"), ("s", "1", "A"))
    assert [log.append_events(rows, path), log.append_events(rows, path)] == [2, 0]
    assert log.append_events(batch(spark, ("s", "1", "C"), ("s", "1", "A")), path) == 1
    assert spark.read.parquet(path).count() == 3


def test_first_wins(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, "z"), (1, "c")], "k int, v string").coalesce(1)
    assert {tuple(r) for r in log.new_rows(rows, None, ["k"]).collect()} == {(1, "b"), (2, "z")}


def test_upsert_and_publish(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "c", 0), (3, "d", 5), (3, "e", 6)], "k int, v string, at int")
    found = log.upserted(old, new, ["k"], [F.col("at")])
    assert {(r.k, r.v) for r in found.collect()} == {(1, "a"), (2, "c"), (3, "e")}
    root = f"file://{tmp_path}/bills"
    log.publish(old, root)
    log.publish(found, root)
    assert log.current(spark, root).count() == 3
    log.replace_partitions(old, f"file://{tmp_path}/parts", ["k"])
    log.replace_partitions(new.filter("k = 2"), f"file://{tmp_path}/parts", ["k"])
    assert {(r.k, r.v) for r in spark.read.parquet(f"file://{tmp_path}/parts").collect()} == {(1, "a"), (2, "c")}


def test_bands(spark):
    cells = spark.createDataFrame([("a", float(x)) for x in (1, 1, 2, 3, 5, 8, 0)] + [("b", 0.0)] + [("c", float(x)) for x in (1, 2, 3, 4)], "e string, intensity double")
    q = {r.e: (r.q1, r.q2, r.q3) for r in thresholds(cells, ["e"]).collect()}
    assert q == {"a": (1, 3, 5), "c": (2, 3, 4)}
    bands = {(r.e, r.intensity): r.band for r in banded(cells, ["e"]).collect()}
    assert bands["b", 0.0] == 0 and bands["a", 1.0] == 1 and bands["a", 2.0] == 2 and bands["a", 8.0] == 4 and bands["a", 0.0] == 0


def test_streamed_append(spark, tmp_path):
    rows = batch(spark, ("s", "1", "A"), ("s", "2", "B"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for k in range(2):  # a second run, as if nothing had been committed
        jobs.append_log(stream, f"file://{tmp_path}/log", f"file://{tmp_path}/ck{k}").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/log").count() == 2
