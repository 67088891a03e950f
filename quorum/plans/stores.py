"""Stores that are written and read back: versions, partitions, second roots, the runner of sources, the log from a stream."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import eventlog
from ..schemas import table
from ..session import scratch
from ..sources import readers, runner
from ..streaming import jobs
from .landed import amendment, text
from .registry import query


@query("SELECT 'current' AS version, o_orderstatus AS status, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS amount FROM orders WHERE o_orderstatus <> 'P' GROUP BY 2 UNION ALL SELECT 'before', o_orderstatus, count(*), sum(o_totalprice::DECIMAL(18,2))::DOUBLE FROM orders GROUP BY 2")
def published_versions(spark, sf_dir):
    """A table replaced as a whole: readers find the last version published, and that before it is still there for those who have begun to read it."""
    root, orders = scratch(spark, "published"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    before = eventlog.publish(orders, root)
    eventlog.publish(orders.filter("o_orderstatus <> 'P'"), root)

    def counted(df, version):
        return df.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("amount")).select(F.lit(version).alias("version"), "status", "n", "amount")

    return counted(eventlog.current(spark, root), "current").unionByName(counted(spark.read.parquet(before), "before"))


@query("SELECT year(o_orderdate)::INT AS year, count(*) AS n, count(*) FILTER (year(o_orderdate) >= 1996) AS replaced FROM orders WHERE year(o_orderdate) < 1996 OR o_orderkey % 2 = 0 GROUP BY 1")
def replaced_partitions(spark, sf_dir):
    """A table of which some years are replaced: the others' files aren't touched."""
    path, year = scratch(spark, "partitions"), F.year("o_orderdate")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", year.alias("year"), F.lit(0).alias("run"))
    eventlog.replace_partitions(rows.repartition("year"), path, ["year"])
    eventlog.replace_partitions(rows.filter("year >= 1996 AND o_orderkey % 2 = 0").withColumn("run", F.lit(1)).repartition("year"), path, ["year"])
    return spark.read.parquet(path).groupBy("year").agg(F.count("*").alias("n"), F.sum("run").cast("long").alias("replaced"))


@query("SELECT 'both' AS kind, n_regionkey AS region, count(*) AS n FROM (SELECT * FROM nation UNION ALL SELECT * FROM nation WHERE n_nationkey % 2 = 0) GROUP BY 2 UNION ALL SELECT 'second', n_regionkey, count(*) FROM nation WHERE n_nationkey % 2 = 0 GROUP BY 2")
def attached_roots(spark, sf_dir):
    """Tables of a second root beside the first's: one that both have, one that only the second has, and one that none has, which is empty."""
    second, nation = scratch(spark, "second"), table(spark, sf_dir, "nation")
    for name in ("nation", "visitors"):
        nation.filter("n_nationkey % 2 = 0").write.parquet(f"{second}/{name}.parquet")
    kind = "n_nationkey int, n_name string, n_regionkey int"
    found = [readers.landed(spark, [sf_dir, second], f"{name}.parquet", kind).select(F.lit(as_).alias("kind"), F.col("n_regionkey").alias("region")) for name, as_ in (("nation", "both"), ("visitors", "second"), ("nobody", "none"))]
    return found[0].unionByName(found[1]).unionByName(found[2]).groupBy("kind", "region").agg(F.count("*").alias("n"))


@query("""SELECT 'first' AS run, 'congress_amendments' AS what, count(*) FILTER (o_orderkey % 5 <> 0 AND o_orderkey % 6 < 5) AS n FROM orders UNION ALL SELECT 'first', 'committees', (SELECT count(*) FROM part) UNION ALL SELECT 'early', 'congress_amendments', 0
UNION ALL SELECT 'second', 'congress_amendments', count(*) FILTER (o_orderkey % 5 <> 0 AND o_orderkey % 6 = 5) FROM orders UNION ALL SELECT 'in all', 'congress_amendments', count(*) FILTER (o_orderkey % 5 <> 0) FROM orders""")
def source_runs(spark, sf_dir):
    """Sources run from day to day: what is due is read, days behind the cursor again, and only what is new is added; a source that isn't due adds nothing."""
    root, store, k, p = scratch(spark, "landed"), scratch(spark, "store"), F.col("o_orderkey"), F.col("p_partkey")
    mine = {n: runner.SOURCES[n] for n in ("congress_amendments", "committees")}
    land = lambda rows, at: rows.select("day", "value").write.mode("append").option("compression", "gzip").partitionBy("day").text(f"{root}/{at}")
    days = F.date_add(F.lit("2025-01-01").cast("date"), (k % 6).cast("int")).cast("string")  # six days, the last of which lands late
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", days.alias("day")).repartition("o_orderkey").sortWithinPartitions("day")  # dealt by keys, not by so few days, and before they are documents
    docs = orders.select("day", (k % 6).alias("part"), F.to_json(F.struct(amendment(k).alias("amendment"))).alias("value"))
    land(docs.filter("part < 5"), "congress_amendments")
    land(table(spark, sf_dir, "part").select(F.lit("2025-01-04").alias("day"), F.to_json(F.struct(text("HS", p).alias("thomas_id"), F.col("p_name").alias("name"), F.lit("house").alias("type"))).alias("value")), "committees")
    first = runner.run(spark, root, store, date(2025, 1, 7), mine)
    land(docs.filter("part = 5"), "congress_amendments")
    early = runner.run(spark, root, store, date(2025, 1, 7), mine)
    second = runner.run(spark, root, store, date(2025, 1, 8), mine)
    added = [("first", first["events"]), ("early", early["events"]), ("second", second["events"])]
    out = spark.createDataFrame([(r, "congress_amendments", int(n)) for r, n in added], "run string, what string, n long")  # three numbers
    log = spark.read.parquet(f"{store}/log").groupBy(F.lit("in all").alias("run"), F.col("source").alias("what")).agg(F.count("*").alias("n"))
    rows = eventlog.current(spark, f"{store}/committees").agg(F.count("*").alias("n")).select(F.lit("first").alias("run"), F.lit("committees").alias("what"), "n")
    return out.unionByName(log).unionByName(rows)


@query("SELECT event_type AS source, count(*) AS n, count(DISTINCT user_id) AS entities, min(ts)::DATE AS first_day FROM events GROUP BY 1")
def streamed_log(spark, sf_dir):
    """Landed files appended to the log by a stream, some files a batch: each batch adds what the log hasn't, so all files landed twice add nothing."""
    base, log = scratch(spark, "stream"), scratch(spark, "log")
    hashed = F.substring(F.sha2("props", 256), 1, 16)
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("event_id").cast("string").alias("source_id"), F.col("user_id").cast("string").alias("entity_id"), F.col("event_type"), F.col("ts").cast("timestamp").alias("observed_at"), F.col("ts").cast("timestamp").alias("occurred_at"), hashed.alias("payload_hash"), F.col("props").alias("payload"), F.lit(1).alias("schema_version"))
    for _ in range(2):
        rows.repartition(4).write.mode("append").parquet(f"{base}/landed")
    stream = jobs.event_stream(spark, f"{base}/landed", rows.schema.simpleString()[7:-1].replace(":", " "), files_per_batch=3)
    stream.writeStream.foreachBatch(lambda batch, _: eventlog.append_events(batch, log) and None).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(log).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("entities"), F.to_date(F.min("occurred_at")).alias("first_day"))

