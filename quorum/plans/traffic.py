"""Traffic, texts and scalar functions: page views, agents, hashes, references, token estimates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import civic, tables
from ..schemas import table
from ..text.clean import packed_in_order
from .civics import _BOT, _PROBE, _STAGE, _VIEWS, views
from .registry import query

def _machine() -> Column:
    return tables.is_bot(F.col("ua")) | tables.is_probe(F.col("path"))


def _views(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("path", F.concat(F.lit("/"), "event_type"))


@query(f"SELECT count(*) AS views, count(*) FILTER ({_BOT} OR {_PROBE}) AS bots, count(DISTINCT user_id) AS visitors, round(100.0 * count(*) FILTER ({_BOT} OR {_PROBE}) / count(*), 6)::DOUBLE AS bot_pct FROM {_VIEWS} WHERE ts > TIMESTAMP '2024-01-23' AND ts <= TIMESTAMP '2024-01-30'")
def traffic_summary(spark, sf_dir):
    """The last week's views and visitors, and how many of the views were bots', by their agent or by what they asked for."""
    now = F.lit("2024-01-30").cast("timestamp_ntz")  # "now" is a parameter
    week = views(spark, sf_dir).filter((F.col("ts") > now - F.expr("INTERVAL 7 DAYS")) & (F.col("ts") <= now))
    bots = F.count_if(_machine())
    return week.agg(F.count("*").alias("views"), bots.alias("bots"), F.count_distinct("user_id").alias("visitors"), F.round(F.lit(100.0) * bots / F.count("*"), 6).alias("bot_pct"))


@query("SELECT '/' || event_type AS path, count(*) AS views, count(DISTINCT user_id) AS visitors FROM events WHERE event_type <> 'error' GROUP BY 1 ORDER BY views DESC, path LIMIT 3")
def top_paths(spark, sf_dir):
    return _views(spark, sf_dir).filter("event_type <> 'error'").groupBy("path").agg(F.count("*").alias("views"), F.count_distinct("user_id").alias("visitors")).orderBy(F.desc("views"), "path").limit(3)


@query(f"SELECT ts::DATE AS day, count(*) FILTER (bot) AS bots, count(*) FILTER (NOT bot) AS people, count(DISTINCT user_id) FILTER (NOT bot) AS visitors FROM (SELECT ts, user_id, {_BOT} OR {_PROBE} AS bot FROM {_VIEWS}) GROUP BY 1")
def bot_split(spark, sf_dir):
    """Bots' and people's views by day."""
    seen = views(spark, sf_dir).withColumn("bot", _machine())
    people = F.when(~F.col("bot"), F.col("user_id"))
    return seen.groupBy(F.to_date("ts").alias("day")).agg(F.count_if("bot").alias("bots"), F.count_if(~F.col("bot")).alias("people"), F.count_distinct(people).alias("visitors"))


@query("""SELECT CASE WHEN event_id % 13 IN (1, 5, 12) THEN 'people' ELSE ['Googlebot', '', 'curl', 'other-bot', 'GPTBot', '', 'PerplexityBot', 'other-bot', 'python-requests', 'Slackbot', 'other-bot', 'ClaudeBot', ''][event_id % 13 + 1] END AS agent, count(*) AS views FROM events GROUP BY 1""")
def ua_bucket(spark, sf_dir):
    """Views by the name of the bot that an agent tells of, all people's under one."""
    ua = F.col("ua")
    return views(spark, sf_dir).groupBy(F.when(tables.is_bot(ua), tables.agent_name(ua)).otherwise("people").alias("agent")).agg(F.count("*").alias("views"))


@query("SELECT event_id, substr(sha256(substr(sha256('quorum' || ts::DATE::VARCHAR), 1, 32) || user_id::VARCHAR || event_type), 1, 16) AS visitor FROM events")
def visitor_hash(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", civic.visitor_hash(F.col("user_id").cast("string"), F.col("event_type"), F.to_date("ts"), "quorum").alias("visitor"))


@query("SELECT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, count(*) AS pages FROM pages GROUP BY 1")
def referer_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(civic.referer_host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))


@query("SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS tokens, CASE WHEN greatest(1, length(text) // 4) * 100 <= 180000 THEN 'small-single' WHEN greatest(1, length(text) // 4) * 100 <= 900000 THEN 'large-single' WHEN greatest(1, length(text) // 4) * 100 <= 1800000 THEN 'chunked' ELSE 'punt' END AS tier FROM documents")
def token_estimate(spark, sf_dir):
    n = civic.estimated_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("tokens"), civic.summary_tier(n * 100).alias("tier"))


@query("""SELECT o_orderkey, unnest(CASE o_orderkey % 6 WHEN 0 THEN ['119:s:' || n] WHEN 1 THEN list_sort(['118:hr:' || n, '118:s:' || (n + 1)]) WHEN 2 THEN ['118:hjres:' || n] WHEN 3 THEN list_sort(['119:hconres:' || n, '119:hres:' || (n + 1)]) WHEN 4 THEN ['118:sconres:' || n, '118:sjres:' || n] ELSE [] END) AS bill_id
FROM (SELECT o_orderkey, o_orderkey % 90000 + 1 AS n FROM orders)""")
def bill_refs_extract(spark, sf_dir):
    """The bills that filings' texts name: each of the forms in use, and what only looks like one."""
    k, n = F.col("o_orderkey"), (F.col("o_orderkey") % 90000 + 1).cast("string")
    after = (F.col("o_orderkey") % 90000 + 2).cast("string")
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    texts = (say("see S. ", n, " and s", n), say("S.", after, "/HR.", n, ": Combating"), say("H.J.Res. ", n), say("H.Con.Res.", n, "; H.Res. ", after), say("S. Con. Res. ", n, ", s j res ", n), say("H R 0, HR 123456, U.S. ", n))
    years = (2025, 2024, 2023, 2026, 2023, 2025)
    said = table(spark, sf_dir, "orders").select(k, F.element_at(F.array(*texts), (k % 6 + 1).cast("int")).alias("t"), F.element_at(F.array(*map(F.lit, years)), (k % 6 + 1).cast("int")).alias("y"))
    return said.select("o_orderkey", F.explode(civic.bill_references(F.col("t"), F.col("y"))).alias("bill_id"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'hr' WHEN 1 THEN 'hconres' WHEN 2 THEN 's' WHEN 3 THEN 'sjres' END AS bill_type, CASE WHEN o_orderkey % 6 < 4 THEN o_orderkey::INT END AS number FROM orders""")
def legis_numbers(spark, sf_dir):
    """Type and number by the labels of roll calls; those that aren't a bill's have none."""
    k = F.col("o_orderkey")
    label = F.element_at(F.array(*[F.concat(F.lit(x), k.cast("string")) for x in ("H R ", "H. Con. Res. ", "S ", "s.j. res. ", "QUORUM")], F.lit("H R")), (k % 6 + 1).cast("int"))
    return table(spark, sf_dir, "orders").withColumn("b", civic.bill_of_label(label)).select("o_orderkey", "b.bill_type", "b.number")


@query(f"SELECT {_STAGE} AS stage, count(*) AS n FROM (SELECT '' AS c, role AS t, text AS x FROM conversations) GROUP BY 1")
def action_stages(spark, sf_dir):
    """Texts by the stage of a bill's way that they tell of, as actions without a code."""
    return table(spark, sf_dir, "conversations").groupBy(tables.stage(F.lit(""), F.col("role"), F.col("text")).alias("stage")).agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, turn, greatest(1, length(text) // 4)::BIGINT AS size FROM conversations),
r AS (SELECT conv_id, i, turn, size AS used, 0 AS chunk FROM t WHERE i = 1
UNION ALL SELECT t.conv_id, t.i, t.turn, CASE WHEN r.used + t.size <= 100 OR r.used = 0 THEN r.used + t.size ELSE t.size END, CASE WHEN r.used + t.size <= 100 OR r.used = 0 THEN r.chunk ELSE r.chunk + 1 END FROM r JOIN t ON t.conv_id = r.conv_id AND t.i = r.i + 1)
SELECT conv_id, turn, chunk::INT AS chunk FROM r""")
def packed_turns(spark, sf_dir):
    """Turns packed in order under a budget of tokens; a chunk's number depends on all before it, so a conversation's sizes (16 bytes a turn, no texts) meet in one row."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", civic.estimated_tokens(F.col("text")).alias("size"))
    per = said.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "size"))).alias("t"))
    chunks = per.select("conv_id", F.col("t.turn").alias("turn"), packed_in_order(F.col("t.size"), 100).alias("chunk"))
    return chunks.select("conv_id", F.explode(F.arrays_zip("turn", "chunk")).alias("x")).select("conv_id", "x.turn", "x.chunk")


_ESCAPED = "replace(replace(replace(url || '?a=1&b=<2>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"SELECT page_id, '<url><loc>' || {_ESCAPED} || '</loc><priority>' || CASE WHEN page_id % 10 = 0 THEN '0.9' ELSE '0.5' END || '</priority></url>' AS entry FROM pages")
def sitemap(spark, sf_dir):
    """An entry per page, its address escaped."""
    priority, url = F.when(F.col("page_id") % 10 == 0, "0.9").otherwise("0.5"), F.concat("url", F.lit("?a=1&b=<2>"))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        url = F.replace(url, F.lit(sign), F.lit(name))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("<url><loc>"), url, F.lit("</loc><priority>"), priority, F.lit("</priority></url>")).alias("entry"))


@query("""SELECT conv_id, turn, bill FROM (SELECT conv_id, turn, unnest(['119:hr:' || (conv_id + 1), '119:s:' || (turn + 1), '119:hjres:' || (conv_id + 2)]) AS bill FROM conversations)""")
def mentioned_bills(spark, sf_dir):
    """The bills that texts name, in the forms that are in use."""
    text = F.concat("text", F.lit(" see H.R. "), (F.col("conv_id") + 1).cast("string"), F.lit(", s"), (F.col("turn") + 1).cast("string"), F.lit("/U.S. 7 and H.J. Res. "), (F.col("conv_id") + 2).cast("string"))
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.explode(civic.bill_references(text, F.lit(2025))).alias("bill"))


@query("SELECT user_id, '{\"user_id\":' || user_id || ',\"events\":' || count(*) || ',\"types\":' || count(DISTINCT event_type) || '}' AS body FROM events GROUP BY user_id")
def json_api(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("events"), F.count_distinct("event_type").alias("types"))
    return per.select("user_id", F.to_json(F.struct("user_id", "events", "types")).alias("body"))


@query("SELECT lang, source, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most FROM documents WHERE lang = 'en' OR source = 'src1' OR n_chars > 10000 GROUP BY ALL")
def faceted_search(spark, sf_dir):
    facets = [F.col("lang") == "en", F.col("source") == "src1", F.col("n_chars") > 10000]
    return table(spark, sf_dir, "documents").filter(reduce(lambda a, b: a | b, facets)).groupBy("lang", "source").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query("""SELECT host, count(*) AS views FROM (SELECT nullif(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), 'blog.tionsh.example.com') AS host FROM events JOIN pages ON page_id = event_id % 60
WHERE ts > TIMESTAMP '2024-01-23' AND ts <= TIMESTAMP '2024-01-30' AND event_type <> 'error') WHERE host IS NOT NULL GROUP BY 1 ORDER BY views DESC, host LIMIT 20""")
def top_referers(spark, sf_dir):
    """The hosts that most of the last week's views came from, bots' aside; a site's own host is none."""
    now = F.lit("2024-01-30").cast("timestamp_ntz")
    week = table(spark, sf_dir, "events").filter((F.col("ts") > now - F.expr("INTERVAL 7 DAYS")) & (F.col("ts") <= now) & (F.col("event_type") != "error"))
    host = civic.referer_host(F.col("url"), "blog.tionsh.example.com")
    from_pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), host.alias("host")).filter("host IS NOT NULL")
    return week.select((F.col("event_id") % 60).alias("page")).join(from_pages, "page").groupBy("host").agg(F.count("*").alias("views")).orderBy(F.desc("views"), "host").limit(20)
