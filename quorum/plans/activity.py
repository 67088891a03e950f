"""The event log's read side: grids, totals, leaderboards, member statistics. Events stand for votes; props.k >= 90 for a broken party line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.grids import banded, daily_intensity, dense, weighted, week_place
from ..schemas import table
from ..text import render
from .registry import ORACLE_SQL, query

WEIGHTS = {"click": 1.0, "view": 0.25, "signup": 2.0, "purchase": 3.0, "error": -0.5}
BREAK_WEIGHT = 5.0

_CASE = "CASE WHEN event_type = 'purchase' AND (props->>'k')::INT >= 90 THEN 5.0 WHEN event_type = 'purchase' THEN 3.0 WHEN event_type = 'click' THEN 1.0 WHEN event_type = 'view' THEN 0.25 WHEN event_type = 'signup' THEN 2.0 WHEN event_type = 'error' THEN -0.5 ELSE 0.0 END"
_DAILY = f"SELECT user_id, ts::DATE AS day, sum({_CASE})::DOUBLE AS intensity, count(*)::BIGINT AS cnt FROM events GROUP BY ALL"
_DENSE = f"SELECT u.user_id, d.day::DATE AS day, coalesce(g.intensity, 0)::DOUBLE AS intensity, coalesce(g.cnt, 0)::BIGINT AS cnt FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY)) AS day FROM events) d LEFT JOIN ({_DAILY}) g ON g.user_id = u.user_id AND g.day = d.day::DATE"
_BAND = "CASE WHEN x.intensity <= 0 OR t.q1 IS NULL THEN 0 WHEN x.intensity <= t.q1 THEN 1 WHEN x.intensity <= t.q2 THEN 2 WHEN x.intensity <= t.q3 THEN 3 ELSE 4 END::INT"
_QS = ", ".join(f"list(intensity ORDER BY intensity)[floor(count(*) * {q})::INT + 1] AS q{i}" for i, q in ((1, 0.25), (2, 0.5), (3, 0.75)))


def k() -> Column:
    """The number in an event's payload."""
    return F.get_json_object("props", "$.k").try_cast("int")


def broken() -> Column:
    return k() >= 90


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_intensity(events(spark, sf_dir), "user_id", "ts", weighted(F.col("event_type"), WEIGHTS, broken(), "purchase", BREAK_WEIGHT))


@query(_DAILY)
def activity_grid(spark, sf_dir):
    return daily(spark, sf_dir)


@query(f"WITH x AS ({_DENSE}), t AS (SELECT user_id, {_QS} FROM x WHERE intensity > 0 GROUP BY user_id) SELECT x.user_id, x.day, x.intensity, x.cnt, {_BAND} AS band FROM x LEFT JOIN t USING (user_id)")
def activity_grid_dense_bands(spark, sf_dir):
    return banded(dense(daily(spark, sf_dir), "user_id"), ["user_id"])


@query(f"WITH x AS ({_DENSE}), t AS (SELECT {_QS} FROM x WHERE intensity > 0) SELECT x.user_id, x.day, x.intensity, x.cnt, {_BAND} AS band FROM x, t")
def cohort_bands(spark, sf_dir):
    return banded(dense(daily(spark, sf_dir), "user_id"), [])


@query(f"""WITH d AS (SELECT ts::DATE AS day, count(*)::BIGINT AS cnt FROM events GROUP BY 1),
x AS (SELECT s.day::DATE AS day, coalesce(d.cnt, 0)::BIGINT AS cnt, coalesce(d.cnt, 0)::DOUBLE AS intensity FROM (SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY)) AS day FROM events) s LEFT JOIN d ON d.day = s.day::DATE),
t AS (SELECT {_QS} FROM x WHERE intensity > 0) SELECT x.day, x.intensity, x.cnt, {_BAND} AS band FROM x, t""")
def site_grid(spark, sf_dir):
    df = daily_intensity(events(spark, sf_dir).withColumn("site", F.lit(1)), "site", "ts", F.lit(1.0))
    return banded(dense(df, "site"), []).drop("site")


@query("SELECT count(*) AS n_events, count(*) FILTER (event_type = 'purchase') AS n_purchases, count(*) FILTER (event_type = 'error') AS n_errors, count(*) FILTER ((props->>'k')::INT >= 90) AS n_breaks, min(ts)::DATE AS first_day, max(ts)::DATE AS last_day FROM events")
def site_totals(spark, sf_dir):
    kind = F.col("event_type")
    return events(spark, sf_dir).agg(F.count("*").alias("n_events"), F.count_if(kind == "purchase").alias("n_purchases"), F.count_if(kind == "error").alias("n_errors"), F.count_if(broken()).alias("n_breaks"), F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day"))


@query("SELECT count(DISTINCT props->>'k') AS n_k, count(DISTINCT event_type || ':' || (props->>'k')) AS n_pairs, count(DISTINCT user_id) AS n_users FROM events")
def distinct_composite(spark, sf_dir):
    text = F.get_json_object("props", "$.k")
    return events(spark, sf_dir).agg(F.count_distinct(text).alias("n_k"), F.count_distinct(F.concat("event_type", F.lit(":"), text)).alias("n_pairs"), F.count_distinct("user_id").alias("n_users"))


@query("SELECT ts::DATE AS day, count(*) AS cnt FROM events GROUP BY 1 ORDER BY cnt DESC, day LIMIT 5")
def pulse_busiest(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "day").limit(5)


@query("SELECT s.dow::INT AS dow, count(e.ts) AS cnt FROM (SELECT unnest(range(7)) AS dow) s LEFT JOIN events e ON extract(dow FROM e.ts) = s.dow GROUP BY 1")
def pulse_dow(spark, sf_dir):
    found = events(spark, sf_dir).groupBy((F.dayofweek("ts") - 1).alias("dow")).agg(F.count("*").alias("cnt"))
    return spark.range(7).select(F.col("id").cast("int").alias("dow")).join(F.broadcast(found), "dow", "left").fillna(0)


@query("SELECT count(*) AS active_days, max(cnt) AS peak, round(avg(cnt), 6) AS mean FROM (SELECT ts::DATE AS day, count(*) AS cnt FROM events GROUP BY 1)")
def pulse_days(spark, sf_dir):
    per_day = events(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("cnt"))
    return per_day.agg(F.count("*").alias("active_days"), F.max("cnt").alias("peak"), F.round(F.avg("cnt"), 6).alias("mean"))


def _named(spark, sf_dir, top):
    """The top rows of known members: those without a name go after the limit, so fewer may be left."""
    members = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name", "c_mktsegment")
    return members.join(F.broadcast(top), "user_id")


@query("SELECT t.user_id, c_name, c_mktsegment, evts FROM (SELECT user_id, count(*) AS evts FROM events GROUP BY 1 ORDER BY evts DESC, user_id LIMIT 20) t JOIN customer ON c_custkey = t.user_id")
def most_active(spark, sf_dir):
    return _named(spark, sf_dir, events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("evts")).orderBy(F.desc("evts"), "user_id").limit(20))


@query("SELECT t.user_id, c_name, c_mktsegment, evts FROM (SELECT user_id, count(*) AS evts FROM events GROUP BY 1 HAVING count(*) > 0 ORDER BY evts, user_id LIMIT 20) t JOIN customer ON c_custkey = t.user_id")
def least_active(spark, sf_dir):
    return _named(spark, sf_dir, events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("evts")).filter("evts > 0").orderBy("evts", "user_id").limit(20))


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS missed, count(*) AS total FROM events GROUP BY 1 HAVING count(*) > 10 ORDER BY missed DESC, user_id LIMIT 12")
def most_absent_having(spark, sf_dir):
    per = events(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("missed"), F.count("*").alias("total"))
    return per.filter("total > 10").orderBy(F.desc("missed"), "user_id").limit(12)


@query("SELECT user_id, breaks, votes, round(100.0 * breaks / nullif(votes, 0), 6)::DOUBLE AS break_pct FROM (SELECT user_id, count(*) FILTER (event_type = 'purchase' AND (props->>'k')::INT >= 90) AS breaks, count(*) FILTER (event_type = 'purchase') AS votes FROM events GROUP BY 1) WHERE votes >= 5 ORDER BY break_pct DESC, user_id LIMIT 10")
def break_rate_topk(spark, sf_dir):
    vote = F.col("event_type") == "purchase"
    per = events(spark, sf_dir).groupBy("user_id").agg(F.count_if(vote & broken()).alias("breaks"), F.count_if(vote).alias("votes"))
    return per.filter("votes >= 5").withColumn("break_pct", F.round(F.lit(100.0) * F.col("breaks") / F.nullif(F.col("votes"), F.lit(0)), 6)).orderBy(F.desc("break_pct"), "user_id").limit(10)


@query("SELECT event_id, user_id, ts, (props->>'k')::INT AS k FROM events WHERE event_type = 'purchase' AND (props->>'k')::INT >= 90 ORDER BY ts DESC, event_id DESC LIMIT 8")
def recent_breaks(spark, sf_dir):
    hit = events(spark, sf_dir).filter((F.col("event_type") == "purchase") & broken())
    return hit.orderBy(F.desc("ts"), F.desc("event_id")).limit(8).select("event_id", "user_id", "ts", k().alias("k"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'error') AS missed,
count(*) FILTER (event_type = 'purchase' AND (props->>'k')::INT < 90) AS party_line, count(*) FILTER (event_type = 'purchase' AND (props->>'k')::INT >= 90) AS breaks, max(ts) AS last_seen,
round(coalesce(count(*) FILTER (event_type = 'purchase' AND (props->>'k')::INT >= 90)::DOUBLE / nullif(count(*) FILTER (event_type = 'purchase' AND (props->>'k') IS NOT NULL), 0), 0), 6) AS break_rate FROM events GROUP BY 1""")
def member_stats(spark, sf_dir):
    kind, vote = F.col("event_type"), F.col("event_type") == "purchase"
    per = events(spark, sf_dir).groupBy("user_id").agg(F.count_if(kind == "click").alias("clicks"), F.count_if(kind == "view").alias("views"), F.count_if(kind == "error").alias("missed"), F.count_if(vote & ~broken()).alias("party_line"), F.count_if(vote & broken()).alias("breaks"), F.max("ts").alias("last_seen"))
    return per.withColumn("break_rate", F.round(F.coalesce(F.try_divide(F.col("breaks"), F.col("party_line") + F.col("breaks")), F.lit(0.0)), 6))


@query("SELECT event_type, n, round(100.0 * n / sum(n) OVER (), 6)::DOUBLE AS share, round(n::DOUBLE / max(n) OVER (), 6) AS width FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def type_shares(spark, sf_dir):
    whole = Window.partitionBy()
    n = events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))
    return n.withColumns({"share": F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(whole), 6), "width": F.round(F.col("n") / F.max("n").over(whole), 6)})


@query("SELECT event_type, count(*) AS cnt FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16' GROUP BY 1")
def day_counts(spark, sf_dir):
    at = F.col("ts")
    return events(spark, sf_dir).filter((at >= F.lit("2024-01-15").cast("timestamp_ntz")) & (at < F.lit("2024-01-16").cast("timestamp_ntz"))).groupBy("event_type").agg(F.count("*").alias("cnt"))


@query("SELECT d::DATE AS day, (d - INTERVAL (extract(dow FROM d)) DAY)::DATE AS week, ((d - INTERVAL (extract(dow FROM d)) DAY)::DATE - (m - INTERVAL (extract(dow FROM m)) DAY)::DATE)::INT // 7 AS col, extract(dow FROM d)::INT AS dow FROM (SELECT DISTINCT ts::DATE AS d, (SELECT min(ts)::DATE FROM events) AS m FROM events)")
def week_matrix(spark, sf_dir):
    days = events(spark, sf_dir).select(F.to_date("ts").alias("day")).distinct()
    week, col, row = week_place(F.col("day"), F.col("first"))
    return days.join(F.broadcast(days.agg(F.min("day").alias("first")))).select("day", week.alias("week"), col.alias("col"), row.alias("dow"))


@query("SELECT event_type, max(struct_pack(ts := ts, event_id := event_id)).ts AS ts, max(struct_pack(ts := ts, event_id := event_id)).event_id AS event_id FROM events GROUP BY 1")
def high_watermarks(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("event_type", "m.ts", "m.event_id")


@query("SELECT event_id, event_type, (props->>'k')::INT AS k, event_type = 'purchase' AND (props->>'k')::INT >= 90 AS party_break FROM events")
def json_shred(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type", k().alias("k"), ((F.col("event_type") == "purchase") & broken()).alias("party_break"))


@query(f"""WITH b AS ({ORACLE_SQL["activity_grid_dense_bands"]}), s AS (SELECT min(day) AS a, max(day) AS z FROM b),
d AS (SELECT unnest(generate_series(a - extract(dow FROM a)::INT, z + (6 - extract(dow FROM z))::INT, INTERVAL 1 DAY))::DATE AS day FROM s)
SELECT user_id, string_agg(line, chr(10) ORDER BY dow) AS text FROM (SELECT u.user_id, extract(dow FROM d.day) AS dow, string_agg(CASE WHEN b.band IS NULL THEN ' ' ELSE ['·', '░', '▒', '▓', '█'][b.band + 1] END, '' ORDER BY d.day) AS line
FROM (SELECT DISTINCT user_id FROM b) u CROSS JOIN d LEFT JOIN b ON b.user_id = u.user_id AND b.day = d.day GROUP BY ALL) GROUP BY user_id""")
def grid_text(spark, sf_dir):
    """All members' grids as text, seven lines each."""
    return render.as_text(activity_grid_dense_bands(spark, sf_dir), "user_id")
