"""Queries of the log's semantics: appends, upserts, merges, latest versions, windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.civic import pair_hash
from ..operators import cache, results
from ..operators import eventlog as log
from ..schemas import table
from ..session import scratch
from .registry import query


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r FROM lineitem) WHERE r = 1")
def idempotent_append(spark, sf_dir):
    lines, key = table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]
    order = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]
    return log.first_per_key(lines.select(*key, "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"), key, order).select(*key, "l_partkey", "l_suppkey", "l_quantity")


@query("SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    half = F.to_date("ts") < F.lit("2024-01-15").cast("date")
    return log.upserted(rows.filter(half), rows.filter(~half), ["user_id"], [F.col("ts"), F.col("event_id")])


@query("SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_per_key(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return log.latest_per_key(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])


@query("SELECT event_id, user_id, event_type FROM events a WHERE ts < TIMESTAMP '2024-01-20' UNION ALL SELECT event_id, user_id, event_type FROM events b WHERE ts >= TIMESTAMP '2024-01-10' AND event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM events a WHERE a.ts < TIMESTAMP '2024-01-20' AND a.event_id = b.event_id AND a.user_id = b.user_id AND a.event_type = b.event_type)")
def anti_merge(spark, sf_dir):
    """A log up to a day and a side store from an earlier day on, which overlap."""
    rows, key = table(spark, sf_dir, "events"), ["event_id", "user_id", "event_type"]
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return log.merged(rows.filter(F.col("ts") < day("2024-01-20")).select(*key), rows.filter(F.col("ts") >= day("2024-01-10")).select(*key), key, F.col("event_type") != "error")


@query("""WITH r AS (SELECT user_id, date_trunc('week', ts)::DATE AS week, event_type AS action, event_id, (props->>'k')::INT AS k, row_number() OVER (PARTITION BY user_id, date_trunc('week', ts), event_type ORDER BY ts DESC, event_id DESC) AS o FROM events),
s AS (SELECT user_id, week, action, string_agg(v, ',' ORDER BY o) AS sources FROM (SELECT user_id, week, action, ['api', 'bulk', 'web'][k % 3 + 1] AS v, min(o) AS o FROM r GROUP BY ALL) GROUP BY ALL),
c AS (SELECT user_id, week, action, string_agg(v, ',' ORDER BY o) AS committees FROM (SELECT user_id, week, action, v, min(o) AS o FROM (SELECT user_id, week, action, 'c' || (k % 7) AS v, o * 2 AS o FROM r WHERE k % 5 <> 0 UNION ALL SELECT user_id, week, action, 'c' || (k % 4), o * 2 + 1 FROM r) GROUP BY ALL) GROUP BY ALL)
SELECT h.user_id, h.week, h.action, h.head, h.versions, sources, committees FROM (SELECT user_id, week, action, arg_min(event_id, o) AS head, count(*) AS versions FROM r GROUP BY ALL) h JOIN s USING (user_id, week, action) JOIN c USING (user_id, week, action)""")
def action_collapse(spark, sf_dir):
    """A member's actions of one week and text as one: the newest stands for them, sources and committees in the order in which they are first seen, newest first."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.concat(F.lit(" "), "event_type", F.repeat(F.lit(" "), (F.col("event_id") % 3).cast("int"))).alias("text"), k.alias("k"))
    name = lambda n: F.concat(F.lit("c"), (F.col("k") % n).cast("string"))
    lists = {"sources": F.array(F.element_at(F.array(*map(F.lit, ("api", "bulk", "web"))), F.col("k") % 3 + 1)), "committees": F.array(F.when(F.col("k") % 5 != 0, name(7)), name(4))}
    keys = [F.col("user_id"), F.to_date(F.date_trunc("week", "ts")).alias("week"), F.trim("text").alias("action")]
    newest = [-F.unix_micros(F.col("ts").cast("timestamp")), -F.col("event_id")]
    one = log.collapsed(rows, keys, newest, lists)
    return one.select("user_id", "week", "action", F.col("head.event_id").alias("head"), F.col("rows").alias("versions"), *[F.array_join(c, ",").alias(c) for c in lists])


@query("""WITH v AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY lang_rank DESC, doc_id DESC) AS r FROM (SELECT doc_id, source, lang, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 999 END AS lang_rank FROM documents))
SELECT source, max(doc_id) FILTER (r = 2) AS from_doc, max(doc_id) FILTER (r = 1) AS to_doc FROM v WHERE r <= 2 GROUP BY source""")
def default_version_pair(spark, sf_dir):
    stage = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for x in ("en", 1, "de", 2, "fr", 3)]), F.col("lang")), F.lit(999))
    order = Window.partitionBy("source").orderBy(F.desc("stage"), F.desc("doc_id"))
    ranked = table(spark, sf_dir, "documents").select("doc_id", "source", stage.alias("stage")).withColumn("r", F.row_number().over(order)).filter("r <= 2")
    return ranked.groupBy("source").agg(F.max(F.when(F.col("r") == 2, F.col("doc_id"))).alias("from_doc"), F.max(F.when(F.col("r") == 1, F.col("doc_id"))).alias("to_doc"))


@query("SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def content_hash_dedupe(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


@query("SELECT l_orderkey, y, q, sum_price FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY y DESC, q DESC) AS r FROM (SELECT l_orderkey, year(l_shipdate)::INT AS y, quarter(l_shipdate)::INT AS q, round(sum(l_extendedprice), 2) AS sum_price FROM lineitem GROUP BY 1, 2, 3)) WHERE r = 1")
def quarter_latest(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("q")).agg(F.round(F.sum("l_extendedprice"), 2).alias("sum_price"))
    return per.groupBy("l_orderkey").agg(F.max(F.struct("y", "q", "sum_price")).alias("m")).select("l_orderkey", "m.*")


@query("SELECT o_custkey, o_orderkey, (rank() OVER w)::INT AS rank, (dense_rank() OVER w)::INT AS dense_rank, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS next, (sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING))::BIGINT AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def running_windows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return log.with_running(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey").drop("o_orderdate")


@query("SELECT user_id, island, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM (SELECT user_id, day, (day - DATE '2024-01-01') - row_number() OVER (PARTITION BY user_id ORDER BY day) AS island FROM (SELECT DISTINCT user_id, ts::DATE AS day FROM events)) GROUP BY user_id, island")
def activity_islands(spark, sf_dir):
    days = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("day"))
    island = F.datediff("day", F.lit("2024-01-01").cast("date")) - place
    return days.withColumn("island", island.cast("long")).groupBy("user_id", "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days"))


@query("""WITH e AS (SELECT user_id, arg_max(struct_pack(p := CASE WHEN event_type <> 'error' THEN event_type END, until := CASE WHEN (props->>'k')::INT < 95 THEN ts + INTERVAL ((props->>'k')::INT) HOUR END), struct_pack(ts, p := CASE WHEN event_type = 'error' THEN '' ELSE event_type END)) AS m FROM events WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY 1)
SELECT c_custkey, CASE WHEN m.until IS NULL OR m.until > TIMESTAMP '2024-01-20' THEN m.p END AS payload, CASE WHEN m IS NULL THEN 'missing' WHEN m.until <= TIMESTAMP '2024-01-20' THEN 'expired' WHEN m.p IS NULL THEN 'negative' ELSE 'hit' END AS state FROM customer LEFT JOIN e ON user_id = c_custkey""")
def cache_lookup(spark, sf_dir):
    """All members asked for as of a moment: what the cache holds for them, or why it has nothing."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    entries = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("payload"), F.col("ts").alias("fetched_at"), F.when(k < 95, F.col("ts") + F.make_dt_interval(hours=k)).alias("expires_at"))
    return cache.looked_up(table(spark, sf_dir, "customer").select("c_custkey"), entries, "c_custkey", F.lit("2024-01-20").cast("timestamp_ntz"))


@query("SELECT o_custkey, url FROM (SELECT o_custkey, url, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, url DESC) AS r FROM orders JOIN pages ON page_id = o_orderkey % 97 WHERE url IS NOT NULL AND o_orderstatus <> 'P') WHERE r = 1")
def hydrated_urls(spark, sf_dir):
    """Each member's address that was found last; what was looked for and not found is left out."""
    found = table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), "url")
    tried = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", (F.col("o_orderkey") % 97).alias("page"), "o_orderstatus").join(found, "page", "left")
    return cache.hydrated(tried.withColumn("url", F.when(F.col("o_orderstatus") != "P", F.col("url"))), ["o_custkey"], "url", "o_orderdate")


_SPLIT = "list_distinct(string_split({}, ' '))"


@query(f"""WITH v AS (SELECT conv_id, turn, {_SPLIT.format("text")} AS new, lag({_SPLIT.format("text")}) OVER w AS old FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, len(list_filter(new, lambda x: NOT list_contains(old, x)))::INT AS added, len(list_filter(old, lambda x: NOT list_contains(new, x)))::INT AS removed, len(list_intersect(new, old))::INT AS kept FROM v WHERE old IS NOT NULL""")
def results_by_content(spark, sf_dir):
    """What changed in words from each turn to the next, found once for each pair of texts and kept by their digests; asked for twice, computed once."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = said.withColumn("old", before).filter("old IS NOT NULL").select("conv_id", "turn", F.sha2("old", 256).alias("from_digest"), F.sha2("text", 256).alias("to_digest"), "old", "text")
    keys = ["from_digest", "to_digest"]

    def compare(rows):
        words = lambda c: F.array_distinct(F.split(c, " "))
        a, b = words("old"), words("text")
        return rows.select(*keys, F.size(F.array_except(b, a)).alias("added"), F.size(F.array_except(a, b)).alias("removed"), F.size(F.array_intersect(a, b)).alias("kept"))

    path, now = scratch(spark, "results"), F.current_timestamp()
    half = pairs.filter("turn <= 2")  # the first asking; the second finds these in the store
    results.computed(half, keys, path, compare, now)
    return results.computed(pairs, keys, path, compare, now).select("conv_id", "turn", "added", "removed", "kept")


@query("SELECT a.source, a.d AS from_doc, b.d AS to_doc, sha256(unhex(sha256(a.text)) || unhex(sha256(b.text))) AS pair FROM (SELECT source, min(doc_id) AS d, arg_min(text, doc_id) AS text FROM documents GROUP BY 1) a JOIN (SELECT source, max(doc_id) AS d, arg_max(text, doc_id) AS text FROM documents GROUP BY 1) b USING (source)")
def version_pair_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ends = docs.groupBy("source").agg(F.min("doc_id").alias("from_doc"), F.max("doc_id").alias("to_doc"))  # ids alone; texts meet them after
    text = lambda c, t: docs.select(F.col("doc_id").alias(c), F.col("text").alias(t))
    both = ends.join(text("from_doc", "a"), "from_doc").join(text("to_doc", "b"), "to_doc")
    return both.select("source", "from_doc", "to_doc", pair_hash(F.col("a"), F.col("b")).alias("pair"))
