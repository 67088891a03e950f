"""The streaming jobs over the events at hand: each runs until what is there is read, and returns what it has written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import table
from ..session import scratch
from ..streaming import jobs
from ..text import clean
from ..text.clean import version_changes
from .activity import WEIGHTS
from .registry import query


def _finished(df: DataFrame, mode: str) -> DataFrame:
    """The result of a stream, run to the end of its input: a table in the shared folder, of which nothing goes through the driver."""
    spark, base = df.sparkSession, scratch(df.sparkSession, "stream")
    out = f"{base}/out"
    spark.createDataFrame([], df.schema).write.parquet(f"{out}/none")  # a stream without a row is a table too

    def write(batch: DataFrame, number: int) -> None:
        """In complete mode each batch is the whole result; else a part, which a repeated batch writes over."""
        batch.write.mode("overwrite").parquet(f"{out}/{'whole' if mode == 'complete' else number}")

    df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(out)


def _stream(spark, sf_dir) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*").withColumn("at", F.col("ts").cast("timestamp"))


@query("SELECT user_id, ts::DATE AS day, sum(CASE event_type WHEN 'purchase' THEN 3.0 WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.25 WHEN 'signup' THEN 2.0 WHEN 'error' THEN -0.5 ELSE 0.0 END)::DOUBLE AS intensity, count(*) AS cnt FROM events GROUP BY ALL")
def streaming_daily_grid(spark, sf_dir):
    return _finished(jobs.daily(_stream(spark, sf_dir), "user_id", "at", WEIGHTS), "complete")


@query("SELECT d::DATE AS first_day, count(*) AS cnt FROM (SELECT unnest(generate_series(ts::DATE - INTERVAL 6 DAY, ts::DATE, INTERVAL 1 DAY)) AS d FROM events) GROUP BY 1")
def streaming_sliding_week(spark, sf_dir):
    return _finished(jobs.sliding(_stream(spark, sf_dir), "at"), "complete").select(F.to_date("start").alias("first_day"), "cnt")


@query("""SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY ALL) GROUP BY 1""")
def streaming_sessions(spark, sf_dir):
    found = _finished(jobs.sessions(_stream(spark, sf_dir), "user_id", "at"), "complete")
    return found.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("cnt").alias("longest"))


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def streaming_dedupe(spark, sf_dir):
    once = jobs.deduplicated(_stream(spark, sf_dir), ["user_id", "event_type"], "at", "365 days")
    return _finished(once.select("user_id", "event_type"), "append").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


def _lines_sql(text: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    for pattern, by in clean.MARKUP:
        text = f"regexp_replace({text}, {quoted(pattern)}, {'chr(10)' if by else quoted(by)}, 'g')"
    for name, char in clean.ENTITIES.items():
        text = f"replace({text}, '&{name};', {quoted(char)})"
    return f"list_transform(string_split({text}, chr(10)), lambda x: trim(regexp_replace(x, {quoted(clean.SPACES)}, ' ', 'g'), ' '))"


@query(f"""SELECT page_id, length(body)::INT AS chars, sha256(body) AS digest FROM (SELECT page_id, trim(array_to_string([x FOR x, i IN ls IF x <> '' OR coalesce(ls[i - 1], '') <> ''], chr(10)), chr(10)) AS body FROM (SELECT page_id, {_lines_sql("coalesce(html, '')")} AS ls FROM pages))""")
def cleaned_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", clean.text_lines(F.col("html")).alias("body")).select("page_id", F.length("body").alias("chars"), F.sha2("body", 256).alias("digest"))


@query()
def version_diffs(spark, sf_dir):
    lines = table(spark, sf_dir, "conversations").withColumn("body", F.regexp_replace("text", r"\. ", ".\n"))
    return version_changes(lines, "conv_id", "turn", "body", scratch(spark, "changes")).select("conv_id", "from", "to", "added", "removed", "unchanged")
