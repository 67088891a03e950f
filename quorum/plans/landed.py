"""Landed raw documents read by their readers: each query lands documents that tell the tables at hand as fetchers write them, and returns what the reader makes of them.

Documents grow with the tables and lie in the shared folder; pages hold 250 records, as those of the services do. The SQL
says the same of the tables, without the documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import table
from ..session import scratch
from ..sources import ratings, readers, texttree
from .civics import _TYPE, bill_type, picked
from .registry import query

PAGE = 250


def put(docs: DataFrame, label: str, each: bool = False) -> str:
    """The folder that docs, a column of texts, were written to, packed by gzip; with each a file for every text. It has no folder below, so listing it is one call."""
    path = scratch(docs.sparkSession, label)
    docs.write.options(compression="gzip", maxRecordsPerFile=1 if each else 0).text(path)
    return path


def paged(number: Column) -> Column:
    return F.floor(number / PAGE).cast("long").alias("page")


def put_pages(rows: DataFrame, label: str, number: Column, field: str, record: Column) -> str:
    """The folder of JSON pages {field: [record, ...]}, a file each, of the rows whose numbers lie in one run of 250."""
    pages = rows.groupBy(paged(number)).agg(F.collect_list(record).alias(field))
    return put(pages.select(F.to_json(F.struct(field)).alias("value")), label, True)


def put_xml(rows: DataFrame, label: str, number: str, doc: Callable[[Column], Column], by: str | None = None) -> str:
    """The folder of XML files, each one element around the documents of the rows whose numbers lie in one run of 250; with by, in a folder for each of its values.

    What travels to a page's task are the rows; documents, several times as long, are made there.
    """
    pages = rows.groupBy(*([by] if by else []), paged(F.col(number))).agg(F.collect_list(F.struct(*rows.columns)).alias("rows")).drop("page")
    docs = pages.withColumn("value", F.concat(F.lit("<all>"), F.array_join(F.transform("rows", doc), ""), F.lit("</all>"))).drop("rows")
    if by is None:
        return put(docs, label, True)
    path = scratch(rows.sparkSession, label)
    docs.repartition(by).write.options(compression="gzip", maxRecordsPerFile=1).partitionBy(by).text(path)
    return path


def put_lines(rows: DataFrame, label: str, *fields: Column) -> str:
    return put(rows.select(F.to_json(F.struct(*fields)).alias("value")), label)


def text(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def day_of(key: Column) -> Column:
    """A day of the years 2024 and 2025."""
    return F.date_add(F.lit("2024-01-01").cast("date"), (key % 700).cast("int"))


def shown(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def said(field: str) -> Column:
    return F.get_json_object("payload", f"$.{field}")


VOTES = ("Aye", "No", "Yea", "Nay", "Present", "Not Voting")
_DAY = "(DATE '2024-01-01' + ({0} % 700)::INT)"
#: Wall clocks in Washington as moments: the clock is four hours behind in summer, else five.
_UTC = "strftime(local + INTERVAL (CASE WHEN local BETWEEN TIMESTAMP '2024-03-10 02:00:00' AND TIMESTAMP '2024-11-03 02:00:00' OR local BETWEEN TIMESTAMP '2025-03-09 02:00:00' AND TIMESTAMP '2025-11-02 02:00:00' THEN 4 ELSE 5 END) HOUR, '%Y-%m-%d %H:%M:%S')"
_VOTES = "SELECT l_orderkey AS k, l_suppkey, l_returnflag AS party, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS ord, ['Yea', 'Nay', 'Yea', 'Nay', 'Present', 'Not Voting'][l_partkey % 6 + 1] AS position FROM lineitem"
_MAJOR = "SELECT k, party, position AS majority FROM (SELECT k, party, position, row_number() OVER (PARTITION BY k, party ORDER BY count(*) DESC, min(ord)) AS r FROM v WHERE position IN ('Yea', 'Nay') GROUP BY 1, 2, 3) WHERE r = 1"
_CAST = "CASE WHEN position = 'Not Voting' THEN 'vote.missed' ELSE 'vote.cast' END AS event_type, position, CASE WHEN position IN ('Yea', 'Nay') THEN (position = majority)::VARCHAR END AS party_line"


def _calls(spark, sf_dir) -> DataFrame:
    """(l_orderkey, v): the votes of each order's lines, some dozen at the most, in order."""
    vote = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(vote)).alias("v"))


def opened(events: DataFrame, fields: str) -> DataFrame:
    """events with these fields of their payload, read once, as p."""
    return events.withColumn("p", F.from_json("payload", fields))


def _seen(events: DataFrame) -> DataFrame:
    return opened(events, "position string, party_line string, legis_num string").select("source_id", "event_type", shown(F.col("occurred_at")).alias("moment"), "p.position", "p.party_line", "p.legis_num")


@query(f"""WITH v AS ({_VOTES}), m AS ({_MAJOR}), t AS (SELECT DISTINCT k, {_DAY.format("k")}::TIMESTAMP + CASE WHEN k % 13 = 0 THEN INTERVAL 12 HOUR ELSE INTERVAL (k % 12 + 9) HOUR + INTERVAL 30 MINUTE END AS local FROM v)
SELECT 'house:119:1st:' || k || ':M' || l_suppkey AS source_id, {_CAST}, {_UTC} AS moment, 'H R ' || k AS legis_num FROM v JOIN t USING (k) LEFT JOIN m USING (k, party)""")
def landed_house_votes(spark, sf_dir):
    """Roll calls of the House as XML: votes by member, spelled one way, with the moment of a clock in Washington (noon where it is missing) and whether they follow their party's majority."""
    def doc(r: Column) -> Column:
        k = r["l_orderkey"]
        votes = F.transform(r["v"], lambda x: text('<recorded-vote><legislator name-id="M', x["l_suppkey"], '" party="', x["l_returnflag"], '" state="OH">X</legislator><vote>', picked(VOTES, x["l_partkey"]), "</vote></recorded-vote>"))
        clock = F.when(k % 13 != 0, text(F.lpad((k % 12 + 9).cast("string"), 2, "0"), ":30")).otherwise("")
        return text("<rollcall-vote><vote-metadata><congress>119</congress><session>1st</session><rollcall-num>", k, "</rollcall-num><legis-num>H R ", k, "</legis-num><action-date>", F.date_format(day_of(k), "dd-MMM-yyyy"), '</action-date><action-time time-etz="', clock, '">x</action-time></vote-metadata><vote-data>', F.array_join(votes, ""), "</vote-data></rollcall-vote>")

    return _seen(readers.house_votes(spark, put_xml(_calls(spark, sf_dir), "house", "l_orderkey", doc)))


@query(f"""WITH i AS (SELECT s_suppkey, 'B' || s_suppkey AS b, 'name' || (s_suppkey % 40) AS name, 'T' || (s_suppkey % 3) AS state FROM supplier WHERE s_suppkey % 10 <> 9), n AS (SELECT name, state, max(b) AS b FROM i GROUP BY ALL),
v AS (SELECT r.*, coalesce(i.b, n.b) AS member FROM ({_VOTES}) r LEFT JOIN i ON i.s_suppkey = l_suppkey AND l_suppkey % 4 <> 0 LEFT JOIN n ON n.name = 'name' || (l_suppkey % 40) AND n.state = 'T' || (l_suppkey % 3) WHERE coalesce(i.b, n.b) IS NOT NULL),
m AS ({_MAJOR}), t AS (SELECT DISTINCT k, {_DAY.format("k")}::TIMESTAMP + CASE WHEN k % 3 = 2 THEN INTERVAL 0 HOUR ELSE INTERVAL (k % 12 + 9) HOUR + INTERVAL 30 MINUTE END AS local FROM v)
SELECT 'senate:119:1:' || k || ':' || member AS source_id, {_CAST}, {_UTC} AS moment, 'S. ' || k AS legis_num FROM v JOIN t USING (k) LEFT JOIN m USING (k, party)""")
def landed_senate_votes(spark, sf_dir):
    """Roll calls of the Senate as XML among pages of HTML: dates in three forms; members by their id, else by name and state, others aren't counted."""
    k, s = F.col("l_orderkey"), F.col("s_suppkey")

    def doc(r: Column) -> Column:
        k = r["l_orderkey"]
        votes = F.transform(r["v"], lambda x: text("<member><lis_member_id>S", x["l_suppkey"], "</lis_member_id><last_name>NAME", x["l_suppkey"] % 40, "</last_name><state>T", x["l_suppkey"] % 3, "</state><party>", x["l_returnflag"], "</party><vote_cast>", picked(VOTES, x["l_partkey"]), "</vote_cast></member>"))
        at = F.to_timestamp(text(day_of(k), " ", k % 12 + 9, ":30"), "yyyy-MM-dd H:mm")
        date = F.when(k % 3 == 0, F.date_format(at, "MMMM d, yyyy, hh:mm a")).when(k % 3 == 1, F.date_format(at, "MMMM d, yyyy,  h:mm a")).otherwise(F.date_format(at, "MMMM d, yyyy."))
        return text("<roll_call_vote><congress>119</congress><session>1</session><vote_number>", k, "</vote_number><vote_date>", date, "</vote_date><document><document_type>S.</document_type><document_number>", k, "</document_number></document><members>", F.array_join(votes, ""), "</members></roll_call_vote>")

    path = put_xml(_calls(spark, sf_dir), "senate", "l_orderkey", doc)
    _calls(spark, sf_dir).filter(k % 50 == 0).select(F.lit("<html><body>Not found</body></html>").alias("value")).write.mode("append").option("compression", "gzip").text(path)
    index = table(spark, sf_dir, "supplier").filter(s % 10 != 9).select(F.when(s % 4 != 0, text("S", s)).alias("lis"), text("B", s).alias("bioguide"), text("Name", s % 40).alias("last_name"), text("T", s % 3).alias("state"))
    return _seen(readers.senate_votes(spark, path, index))


def _bill_status(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_set("l_suppkey")).alias("co"), F.sort_array(F.collect_set(F.struct("l_linenumber", "l_partkey"))).alias("acts"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(lines, "o_orderkey", "left")

    def doc(r: Column) -> Column:
        k = r["o_orderkey"]
        co = F.transform(r["co"], lambda s: text("<item><bioguideId>M", s, "</bioguideId><sponsorshipDate>", day_of(k + s % 5), "</sponsorshipDate><isOriginalCosponsor>", F.when(s % 2 == 0, "True").otherwise("False"), "</isOriginalCosponsor></item>"))
        acts = F.transform(r["acts"], lambda a: text("<item><actionDate>", day_of(k + a["l_linenumber"]), "</actionDate><actionCode>H", a["l_linenumber"], "</actionCode><type>Floor</type><text>Read &amp; sent ", a["l_partkey"], "</text>", F.when(a["l_partkey"] % 2 == 0, text("<committees><item><name>C", a["l_partkey"] % 9, "</name></item></committees>")).otherwise(""), "</item>"))
        some = lambda name, items: F.when(F.size(items) > 0, text(f"<{name}>", F.array_join(items, ""), f"</{name}>")).otherwise("")
        return text("<billStatus><bill><congress>119</congress><type>", F.upper(bill_type(k)), "</type><number>", k, "</number><title>Act &lt;", k, "&gt;</title><introducedDate>", day_of(k), "</introducedDate><latestAction><text>Sent &amp; read</text><actionDate>", day_of(k + 9), "T10:00:00Z</actionDate></latestAction><policyArea><name>", r["o_orderpriority"], "</name></policyArea>",
                   F.when(k % 7 != 0, text("<sponsors><item><bioguideId>C", r["o_custkey"], "</bioguideId></item><item><bioguideId>X</bioguideId></item></sponsors>")).otherwise(""), some("cosponsors", co), some("actions", acts), "</bill></billStatus>")

    return readers.bill_status(spark, put_xml(rows, "status", "o_orderkey", doc))


_BILLS = f"(SELECT *, '119:' || {_TYPE.format('o_orderkey')} || ':' || o_orderkey AS bill_id FROM orders)"


@query(f"SELECT bill_id, 'Act <' || o_orderkey || '>' AS title, CASE WHEN o_orderkey % 7 <> 0 THEN 'C' || o_custkey END AS sponsor_bioguide, {_DAY.format('o_orderkey')} AS introduced_date, {_DAY.format('(o_orderkey + 9)')} AS latest_action_date, 'Sent & read' AS latest_action_text, o_orderpriority AS policy_area, coalesce(n, 0)::INT AS cosponsor_count FROM {_BILLS} LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def landed_bills(spark, sf_dir):
    """Bill statuses as XML: the table's rows."""
    return _bill_status(spark, sf_dir)[0].select("bill_id", "title", "sponsor_bioguide", "introduced_date", "latest_action_date", "latest_action_text", "policy_area", "cosponsor_count")


@query(f"""SELECT 'sponsor:' || bill_id AS source_id, 'bioguide:C' || o_custkey AS entity_id, 'bill.sponsored' AS event_type, strftime({_DAY.format('o_orderkey')}, '%Y-%m-%d') AS day, 'Act <' || o_orderkey || '>' AS text, NULL::VARCHAR AS original, NULL::VARCHAR AS committee FROM {_BILLS} WHERE o_orderkey % 7 <> 0
UNION ALL SELECT 'cosponsor:' || bill_id || ':M' || l_suppkey, 'bioguide:M' || l_suppkey, 'bill.cosponsored', strftime({_DAY.format('(o_orderkey + l_suppkey % 5)')}, '%Y-%m-%d'), 'Act <' || o_orderkey || '>', (l_suppkey % 2 = 0)::VARCHAR, NULL FROM {_BILLS} JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) ON l_orderkey = o_orderkey
UNION ALL SELECT 'action:' || bill_id || ':' || d || ':H' || l_linenumber || ':' || substr(sha256(t), 1, 12), 'bill:' || bill_id, 'bill.action', d, t, NULL, c FROM (SELECT *, strftime({_DAY.format('(o_orderkey + l_linenumber)')}, '%Y-%m-%d') AS d, 'Read & sent ' || l_partkey AS t, CASE WHEN l_partkey % 2 = 0 THEN 'C' || (l_partkey % 9) END AS c FROM {_BILLS} JOIN (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) ON l_orderkey = o_orderkey)""")
def landed_bill_events(spark, sf_dir):
    """Bill statuses as XML: an event for the first sponsor, each cosponsor and each action."""
    events = opened(_bill_status(spark, sf_dir)[1], "text string, title string, is_original string, committees array<string>")
    return events.select("source_id", "entity_id", "event_type", F.date_format("occurred_at", "yyyy-MM-dd").alias("day"), F.coalesce("p.text", "p.title").alias("text"), F.col("p.is_original").alias("original"), F.get("p.committees", F.lit(0)).alias("committee"))


@query(f"SELECT bill_id, 'C' || o_custkey AS sponsor_bioguide, {_DAY.format('o_orderkey')} AS introduced_date, CASE WHEN o_orderkey % 3 = 0 THEN 'later' ELSE 'first' END AS latest_action_text, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 9 END::INT AS cosponsor_count FROM {_BILLS}")
def landed_bill_details(spark, sf_dir):
    """Details of bills as JSON, some landed twice: that with the latest action counts."""
    k = F.col("o_orderkey")

    def bill(action: str, after: int) -> Column:
        return F.struct(F.lit(119).alias("congress"), F.upper(bill_type(k)).alias("type"), k.cast("string").alias("number"), F.array(F.struct(text("C", F.col("o_custkey")).alias("bioguideId"))).alias("sponsors"), day_of(k).cast("string").alias("introducedDate"), F.struct(F.lit(action).alias("text"), F.date_add(day_of(k), after).cast("string").alias("actionDate")).alias("latestAction"), F.when(k % 4 != 0, F.struct((k % 9).alias("count"))).alias("cosponsors"))

    rows = table(spark, sf_dir, "orders").select(F.explode(F.when(k % 3 == 0, F.array(bill("later", 30), bill("first", 1))).otherwise(F.array(bill("first", 1)))).alias("bill"))
    return readers.bill_details(spark, put_lines(rows, "details", F.col("bill"))).select("bill_id", "sponsor_bioguide", "introduced_date", "latest_action_text", "cosponsor_count")


@query(f"SELECT 'cosponsor:' || bill_id || ':M' || l_suppkey AS source_id, 'bioguide:M' || l_suppkey AS entity_id, strftime({_DAY.format('o_orderkey')}, '%Y-%m-%d') AS day, NULL AS text FROM {_BILLS} JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT 'action:' || bill_id || ':' || d || ':H' || l_linenumber || ':' || substr(sha256(t), 1, 12), 'bill:' || bill_id, d, t FROM (SELECT *, strftime({_DAY.format('(o_orderkey + l_linenumber)')}, '%Y-%m-%d') AS d, 'Read ' || l_partkey AS t FROM {_BILLS} JOIN lineitem ON l_orderkey = o_orderkey)")
def landed_bill_parts(spark, sf_dir):
    """Pages of a bill's cosponsors and of its actions as JSON: an event each."""
    k = F.col("l_orderkey")
    co = F.struct(text("M", F.col("l_suppkey")).alias("bioguideId"), day_of(k).cast("string").alias("sponsorshipDate"), (F.col("l_partkey") % 2 == 0).alias("isOriginalCosponsor"))
    act = F.struct(day_of(k + F.col("l_linenumber")).cast("string").alias("actionDate"), text("H", F.col("l_linenumber")).alias("actionCode"), text("Read ", F.col("l_partkey")).alias("text"))
    per = table(spark, sf_dir, "lineitem").groupBy(k).agg(F.collect_list(co).alias("co"), F.collect_list(act).alias("acts"))
    asked = F.struct(F.lit(119).alias("congress"), F.upper(bill_type(k)).alias("billType"), k.cast("string").alias("billNumber"))
    nothing = F.lit(None)
    pages = per.select(F.explode(F.array(F.struct(asked.alias("request"), F.col("co").alias("cosponsors"), nothing.cast("array<struct<actionDate:string,actionCode:string,text:string>>").alias("actions")), F.struct(asked.alias("request"), nothing.cast("array<struct<bioguideId:string,sponsorshipDate:string,isOriginalCosponsor:boolean>>").alias("cosponsors"), F.col("acts").alias("actions")))).alias("p"))
    events = readers.bill_parts(spark, put_lines(pages, "parts", F.col("p.request"), F.col("p.cosponsors"), F.col("p.actions")))
    return events.select("source_id", "entity_id", F.date_format("occurred_at", "yyyy-MM-dd").alias("day"), said("text").alias("text"))


_FILED = """(SELECT o_orderkey AS k, o_custkey AS c, o_totalprice::DECIMAL(18,2)::DOUBLE AS amount, CASE WHEN (2023 + o_orderkey % 3) = 2025 THEN '119' ELSE '118' END AS g FROM orders)"""
_REFS = "list_sort(CASE WHEN k % 5 = 0 THEN [] ELSE [g || ':hr:' || (k % 90 + 1), g || ':s:' || (c % 50 + 1)] END || CASE WHEN k % 2 = 0 THEN [g || ':hconres:3'] ELSE [] END)"


def _filings(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    k, c, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    activity = lambda code, what: F.struct(F.lit(code).alias("general_issue_code"), what.alias("description"))
    first = F.when(k % 5 != 0, text("H.R. ", k % 90 + 1, " and S. ", c % 50 + 1, "; HR ", k % 90 + 1, ", U.S. 9"))
    made = F.when(k % 2 == 0, F.array(activity("TAX", first), activity("ENV", F.lit("H.Con.Res. 3")))).otherwise(F.array(activity("TAX", first)))
    day = day_of(k).cast("string")
    posted = F.when(k % 4 == 0, text(day, "T10:00:00Z")).when(k % 4 == 1, text(day, "T10:00:00")).when(k % 4 == 2, day).otherwise(text(day, "T10:00:00-04:00"))
    filing = F.struct(text("F", k).alias("filing_uuid"), (2023 + k % 3).alias("filing_year"), F.lit("q1").alias("filing_period"), posted.alias("dt_posted"), F.when(k % 3 != 0, price).alias("income"), F.when(k % 4 != 0, F.lit("90")).alias("expenses"), F.struct((k % 20).alias("id"), text("R", k % 20).alias("name")).alias("registrant"), F.struct(c.alias("id"), text("C", c).alias("name")).alias("client"), made.alias("lobbying_activities"))
    return readers.lobbying_filings(spark, put_pages(table(spark, sf_dir, "orders"), "filings", k, "results", filing))


@query(f"SELECT 'F' || k AS filing_uuid, c::VARCHAR AS client_id, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END::INT AS activities, CASE WHEN k % 2 = 0 THEN 'ENV,TAX' ELSE 'TAX' END AS codes, array_to_string({_REFS}, ',') AS refs, strftime({_DAY.format('k')}::TIMESTAMP + INTERVAL (CASE k % 4 WHEN 2 THEN 0 WHEN 3 THEN 14 ELSE 10 END) HOUR, '%Y-%m-%d %H:%M:%S') AS posted, CASE WHEN k % 3 <> 0 THEN amount END AS income FROM {_FILED}")
def landed_filings(spark, sf_dir):
    """Pages of lobbying filings as JSON: moments in four forms, codes and the bills that the descriptions name, once each and sorted."""
    f = _filings(spark, sf_dir)[0]
    return f.select("filing_uuid", "client_id", F.col("activity_count").alias("activities"), F.array_join("issue_codes", ",").alias("codes"), F.array_join("bill_refs", ",").alias("refs"), shown(F.col("dt_posted")).alias("posted"), F.col("income").cast("double").alias("income"))


@query(f"SELECT 'F' || k || ':' || bill AS source_id, 'bill:' || bill AS entity_id, round(CASE WHEN k % 3 <> 0 THEN amount WHEN k % 4 <> 0 THEN 90 ELSE 0 END / n, 6)::DOUBLE AS share FROM (SELECT k, amount, len({_REFS}) AS n, unnest({_REFS}) AS bill FROM {_FILED})")
def landed_mentions(spark, sf_dir):
    """Pages of lobbying filings as JSON: an event for each bill that a filing names, with its share of the income, or else the expenses."""
    return _filings(spark, sf_dir)[1].select("source_id", "entity_id", F.round(said("amount_share").cast("double"), 6).alias("share"))


@query("""WITH g AS (SELECT event_id AS id, user_id AS u, event_type AS t, ts::DATE AS d, CASE WHEN event_id % 2 = 0 THEN 'house' ELSE 'senate' END AS chamber FROM events WHERE event_type NOT IN ('error', 'signup')),
m AS (SELECT *, u AS member, false AS second FROM g UNION ALL SELECT *, u + 1, true FROM g WHERE id % 3 = 0)
SELECT 'G' || id || ':M' || member AS source_id, 'bioguide:M' || member AS entity_id, strftime(d, '%Y-%m-%d') || ' 12:00:00' AS moment, chamber, 'T & ' || id AS title, CASE WHEN id % 3 = 0 THEN '2' ELSE '1' END AS speakers, CASE WHEN t = 'purchase' THEN '119hr' || id END AS ref FROM m""")
def landed_speeches(spark, sf_dir):
    """Granules of the Record by day as XML: an event for each member named, with the bills referred to; digests and granules without members are none."""
    def doc(r: Column) -> Column:
        i, kind = r["event_id"], r["event_type"]
        member = lambda u: text('<congMember bioGuideId="M', u, '" congress="119" role="SPEAKING" party="D" state="OH"/>')
        members = F.when(kind == "signup", "").when(i % 3 == 0, F.concat(member(r["user_id"]), member(r["user_id"] + 1))).otherwise(member(r["user_id"]))
        refs = F.when(kind == "purchase", text('<isReferringTo type="usc" ID="42"/><isReferringTo type="bill" ID="119hr', i, '"/>')).otherwise("")
        chamber = F.when(kind == "error", "DAILYDIGEST").when(i % 2 == 0, "HOUSE").otherwise("SENATE")
        return text('<relatedItem type="constituent"><titleInfo><title> T &amp; ', i, ' </title></titleInfo><identifier type="preferred citation">171 Cong. Rec. ', i, "</identifier><part><extent><start>H1</start><end>H2</end></extent></part><extension><granuleClass>", chamber, "</granuleClass><accessId>G", i, "</accessId>", members, refs, "</extension></relatedItem>")

    path = put_xml(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")), "speeches", "event_id", doc, "day")
    events = readers.floor_speeches(spark, path)
    return events.select("source_id", "entity_id", shown(F.col("occurred_at")).alias("moment"), said("chamber").alias("chamber"), said("title").alias("title"), said("speaker_count").alias("speakers"), said("bill_refs[0].ref").alias("ref"))


@query(f"""WITH w AS (SELECT l_orderkey AS k, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1 AS i FROM lineitem),
e AS (SELECT DISTINCT k, CASE WHEN k % 3 = 0 THEN 'chamber:house' ELSE 'committee:hs' || (k % 7) END AS entity_id, strftime({_DAY.format('k')}, '%Y-%m-%d') AS day FROM w)
SELECT 'meeting:' || k AS source_id, entity_id, 'committee.meeting' AS event_type, day, NULL AS witness FROM e UNION ALL SELECT 'witness:' || k || ':' || i, entity_id, 'committee.witness', day, 'W' || l_suppkey FROM w JOIN e USING (k)""")
def landed_meetings(spark, sf_dir):
    """Committee meetings as JSON: an event for each and for each witness, in the name of the first committee, else the chamber."""
    k = F.col("l_orderkey")
    heard = F.transform("v", lambda x: F.struct(text("W", x["l_suppkey"]).alias("name"), x["l_returnflag"].alias("organization")))
    by = F.when(k % 3 != 0, F.array(F.struct(text("hs", k % 7).alias("systemCode"), F.lit("First").alias("name")), F.struct(F.lit("hs99").alias("systemCode"), F.lit("Second").alias("name"))))
    meeting = F.struct(k.cast("string").alias("eventId"), F.lit(119).alias("congress"), F.lit("House").alias("chamber"), text(day_of(k), "T10:00:00Z").alias("date"), by.alias("committees"), heard.alias("witnesses"))
    events = readers.committee_meetings(spark, put_lines(_calls(spark, sf_dir), "meetings", meeting.alias("committeeMeeting")))
    return events.select("source_id", "entity_id", "event_type", F.date_format("occurred_at", "yyyy-MM-dd").alias("day"), said("witness_name").alias("witness"))


def amendment(key: Column) -> Column:
    bill = F.struct(F.lit(119).alias("congress"), F.lit("HR").alias("type"), (key % 40).cast("string").alias("number"))
    sponsor = F.when(key % 5 != 0, F.array(F.struct(text("C", F.col("o_custkey")).alias("bioguideId"))))
    return F.struct(F.lit(119).alias("congress"), F.when(key % 2 == 0, "SAMDT").otherwise("HAMDT").alias("type"), key.alias("number"), sponsor.alias("sponsors"), F.when(key % 4 != 0, day_of(key).cast("string")).alias("submittedDate"), text(day_of(key + 1), "T08:00:00Z").alias("updateDate"), F.when(key % 2 == 0, "To strike").alias("purpose"), F.lit("A text").alias("description"), F.when(key % 3 != 0, bill).alias("amendedBill"))


_AMENDED = "SELECT *, '119:' || CASE WHEN o_orderkey % 2 = 0 THEN 'samdt' ELSE 'hamdt' END || ':' || o_orderkey AS source_id FROM orders WHERE o_orderkey % 5 <> 0"


@query(f"SELECT source_id, 'bioguide:C' || o_custkey AS entity_id, strftime(CASE WHEN o_orderkey % 4 <> 0 THEN {_DAY.format('o_orderkey')} ELSE {_DAY.format('(o_orderkey + 1)')} END, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 2 = 0 THEN 'To strike' ELSE 'A text' END AS purpose, CASE WHEN o_orderkey % 3 <> 0 THEN '119:hr:' || (o_orderkey % 40) END AS bill FROM ({_AMENDED})")
def landed_amendments(spark, sf_dir):
    """Amendments as JSON: an event for each that has a sponsor, on the day it was submitted, else changed."""
    path = put_lines(table(spark, sf_dir, "orders"), "amendments", amendment(F.col("o_orderkey")).alias("amendment"))
    return readers.amendments(spark, path).select("source_id", "entity_id", F.date_format("occurred_at", "yyyy-MM-dd").alias("day"), said("purpose").alias("purpose"), said("bill_id").alias("bill"))


@query(f"SELECT '119:hr:' || doc_id AS bill_id, lpad((doc_id % 3)::VARCHAR, 2, '0') AS version_code, {_DAY.format('doc_id')} AS action_date, coalesce(lang, '') || ' & \"' || coalesce(source, '') || '\"' || chr(10) || chr(10) || n_chars || ' signs' AS summary_text FROM documents")
def landed_summaries(spark, sf_dir):
    """Pages of bills' summaries as JSON, their HTML as lines."""
    k, none = F.col("doc_id"), F.lit("")
    html = text("<p><b>", F.coalesce("lang", none), "</b> &amp; &#34;", F.coalesce("source", none), "&#34;</p><script>no()</script><p>", F.col("n_chars"), " <i>signs</i></p>")
    one = F.struct(F.struct(F.lit(119).alias("congress"), F.lit("HR").alias("type"), k.cast("string").alias("number")).alias("bill"), F.lpad((k % 3).cast("string"), 2, "0").alias("versionCode"), day_of(k).cast("string").alias("actionDate"), html.alias("text"), F.lit("2025-01-03T00:00:00Z").alias("updateDate"))
    path = put_pages(table(spark, sf_dir, "documents"), "summaries", k, "summaries", one)
    return readers.bill_summaries(spark, path).select("bill_id", "version_code", "action_date", "summary_text")


@query("""SELECT 'B' || c_custkey AS bioguide_id, CASE WHEN c_custkey % 2 = 0 THEN 'F ' || c_name ELSE 'Hon. ' || c_name END AS full_name, CASE WHEN c_custkey % 4 = 0 THEN 'senate' ELSE 'house' END AS chamber, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 3 + 1 END::INT AS district, c_mktsegment AS party,
DATE '2019-01-03' AS served_from, make_date((2021 + 2 * (c_custkey % 3))::BIGINT, 1, 3) AS served_until, CASE WHEN c_custkey % 4 = 0 THEN 'S' || c_custkey END AS lis FROM customer""")
def landed_members(spark, sf_dir):
    """Members as JSON lines with one to three terms: the last one says what they are, the first since when."""
    k = F.col("c_custkey")
    years = F.sequence(F.lit(0).cast("long"), k % 3)
    terms = F.transform(years, lambda i: F.struct(F.when((k % 4 == 0) & (i == k % 3), "sen").otherwise("rep").alias("type"), text(2019 + 2 * i, "-01-03").alias("start"), text(2021 + 2 * i, "-01-03").alias("end"), F.lit("OH").alias("state"), F.when((k % 4 != 0) | (i != k % 3), i + 1).alias("district"), F.col("c_mktsegment").alias("party")))
    name = F.struct(F.lit("F").alias("first"), F.col("c_name").alias("last"), F.when(k % 2 != 0, text("Hon. ", F.col("c_name"))).alias("official_full"))
    path = put_lines(table(spark, sf_dir, "customer"), "members", F.struct(text("B", k).alias("bioguide"), F.when(k % 4 == 0, text("S", k)).alias("lis")).alias("id"), name.alias("name"), terms.alias("terms"))
    return readers.legislators(spark, path).select("bioguide_id", "full_name", "chamber", "district", "party", "served_from", "served_until", F.get_json_object("ids", "$.lis").alias("lis"))


@query("SELECT 'HS' || p_partkey AS committee_code, p_name AS name, NULL AS parent_code, 'u' || p_partkey AS url FROM part UNION ALL SELECT 'HS' || p_partkey || lpad(i::VARCHAR, 2, '0'), 'Sub ' || i, 'HS' || p_partkey, NULL FROM (SELECT p_partkey, unnest(range(1, p_partkey % 4 + 1)) AS i FROM part)")
def landed_committees(spark, sf_dir):
    """Committees as JSON lines with their subcommittees, as rows of one table."""
    k = F.col("p_partkey")
    subs = F.when(k % 4 != 0, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(k % 4, F.lit(1))), lambda i: F.struct(F.lpad(i.cast("string"), 2, "0").alias("thomas_id"), text("Sub ", i).alias("name"))))
    path = put_lines(table(spark, sf_dir, "part"), "committees", text("HS", k).alias("thomas_id"), F.col("p_name").alias("name"), F.lit("house").alias("type"), text("u", k).alias("url"), subs.alias("subcommittees"))
    return readers.committees(spark, path).select("committee_code", "name", "parent_code", "url")


@query("SELECT 'B' || c_custkey AS bioguide_id, 'HS' || (c_custkey % 5) AS committee_code, c_mktsegment AS party, (c_custkey % 9)::INT AS rank_in_party FROM customer WHERE c_custkey % 17 <> 0")
def landed_assignments(spark, sf_dir):
    """Maps from committees to members as JSON: a row for each member that has an id."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.floor(k / PAGE).cast("long").alias("page"), text("HS", k % 5).alias("code"), F.struct(F.when(k % 17 != 0, text("B", k)).alias("bioguide"), F.col("c_mktsegment").alias("party"), (k % 9).alias("rank"), F.lit("Member").alias("title")).alias("m"))
    per = rows.groupBy("page", "code").agg(F.collect_list("m").alias("ms")).groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("code", "ms"))).alias("all"))
    path = put(per.select(F.to_json("all").alias("value")), "assignments", True)
    return readers.committee_members(spark, path).select("bioguide_id", "committee_code", "party", "rank_in_party")


@query("SELECT 'B' || c_custkey AS bioguide_id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS twitter, CASE WHEN c_custkey % 3 = 1 THEN c_custkey END AS twitter_id FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 1")
def landed_handles(spark, sf_dir):
    """Handles as JSON lines: numbers that aren't are null, and members without any handle are left out."""
    k = F.col("c_custkey")
    social = F.struct(F.when(k % 2 == 0, F.col("c_name")).alias("twitter"), F.when(k % 3 == 1, k.cast("string")).when(k % 3 == 2, "none").alias("twitter_id"))
    path = put_lines(table(spark, sf_dir, "customer"), "handles", F.struct(text("B", k).alias("bioguide")).alias("id"), social.alias("social"))
    return readers.social_handles(spark, path).select("bioguide_id", "twitter", "twitter_id")


STATES = ("Alabama", "Ohio", "West Virginia", "Virginia", "Atlantis")


@query("""SELECT ['AL', 'OH', 'WV', 'VA', 'Atlantis'][s_nationkey % 5 + 1] AS state, CASE WHEN s_suppkey % 50 = 0 THEN 0 ELSE s_suppkey END::INT AS district, CASE WHEN n = 0 THEN 'EVEN' WHEN n > 0 THEN 'R+' || n ELSE 'D+' || (-n) END AS pvi, n::INT AS score FROM (SELECT *, s_suppkey % 21 - 10 AS n FROM supplier)
UNION ALL SELECT DISTINCT 'OH', -1, 'R+' || (s_suppkey // 250 + 1), (s_suppkey // 250 + 1)::INT FROM supplier""")
def landed_ratings(spark, sf_dir):
    """Pages with tables of ratings as HTML: of each page the largest table of states and of districts that have a column for them; places and ratings in their several spellings."""
    k, n = F.col("s_suppkey"), F.col("s_suppkey") % 21 - 10
    state = picked(STATES, F.col("s_nationkey"))
    place = F.when(k % 50 == 0, text(state, " at-large")).when(k % 3 == 0, text(state, "&nbsp;", k)).when(k % 3 == 1, text(state, " ", k, "th")).otherwise(text(state, " ", k))
    rating = F.when(n == 0, " Even ").when(n > 0, text("R+", n, " (new)")).otherwise(text("D + ", -n))
    page = F.floor(k / PAGE).cast("long")
    rows = table(spark, sf_dir, "supplier").groupBy(page.alias("page")).agg(F.array_join(F.collect_list(text("<tr><td>", place, "</td><td>x</td><td>", rating, "</td></tr>")), "").alias("rows"))
    head = lambda kind: f'<table class="wikitable sortable"><tr><th>{kind}</th><th>Member</th><th>2025 PVI</th></tr>'
    html = text("<table><tr><td>Utah</td></tr></table>", head("State"), "<tr><td>Ohio</td><td>x</td><td>R+", F.col("page") + 1, "</td></tr></table>", head("District"), F.col("rows"), "</table>", head("District"), "<tr><td>Guam 9</td><td>x</td><td>D+9</td></tr></table>", '<table class="wikitable"><tr><th>State</th></tr><tr><td>Utah</td></tr></table>')
    path = put(rows.select(html.alias("value")), "ratings", True)
    return ratings.district_ratings(spark, path, 119).select("state", "district", "pvi", "score")


@query("SELECT n_nationkey::VARCHAR AS state, d AS asked, 'R+' || score AS pvi, score FROM nation JOIN (SELECT s_nationkey, s_suppkey % 4 - 1 AS d, max(s_suppkey % 9 + 1)::INT AS score FROM supplier GROUP BY 1, 2) ON s_nationkey = n_nationkey WHERE n_nationkey IN (3, 7, 11) AND d IN (-1, 0, 1)")
def rating_lookup(spark, sf_dir):
    """The ratings of given places from a table bucketed by place, one bucket a place: a senator's is the state's, that of a member at large district 0's."""
    k = F.col("s_suppkey")
    per = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("state"), (k % 4 - 1).cast("int").alias("district")).agg(F.max(k % 9 + 1).cast("int").alias("score"))
    name = "ratings_" + scratch(spark, "r").rsplit("-", 1)[-1]
    ratings.store(per.select(F.lit(119).alias("congress"), "state", "district", text("R+", F.col("score")).alias("pvi"), "score"), name)
    known, out = spark.table(name), None
    for state in ("3", "7", "11"):
        for asked, district, chamber in ((-1, None, "senate"), (0, None, "house"), (1, 1, "House")):
            one = ratings.rating_of(known, 119, state, district, chamber).select(F.lit(state).alias("state"), F.lit(asked).cast("long").alias("asked"), "pvi", "score")
            out = one if out is None else out.unionByName(one)
    return out


@query("SELECT 'B' || c_custkey AS bioguide_id, round(c_acctbal, 2) AS receipts, CASE WHEN c_custkey % 4 <> 0 THEN 5.5 END::DOUBLE AS cash, DATE '2024-12-31' AS coverage_end FROM customer WHERE c_custkey % 3 <> 0")
def landed_totals(spark, sf_dir):
    """Pages of candidates' totals as JSON, by the ids that are resolved; what isn't a number is null."""
    k = F.col("c_custkey")
    one = F.struct(text("H", k).alias("candidate_id"), F.lit(2024).alias("cycle"), F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("receipts"), F.when(k % 4 != 0, "5.5").otherwise("n/a").alias("last_cash_on_hand_end_period"), F.lit("2024-12-31T00:00:00").alias("coverage_end_date"))
    people = table(spark, sf_dir, "customer")
    resolved = people.select(text("B", k).alias("bioguide_id"), F.lit(2024).alias("cycle"), F.when(k % 3 != 0, text("H", k)).alias("fec_id"))
    rows = readers.funding_totals(spark, put_pages(people, "totals", k, "results", one), resolved)
    return rows.select("bioguide_id", F.col("receipts").cast("double").alias("receipts"), F.col("cash_on_hand").cast("double").alias("cash"), "coverage_end")


@query(f"""WITH f AS (SELECT l_orderkey AS k, ['ih', 'eh1s', 'enr'][l_partkey % 3 + 1] AS code, ['.xml', '.htm', '.doc'][l_linenumber % 3 + 1] AS ext, CASE WHEN l_partkey % 7 <> 0 THEN strftime({_DAY.format('l_partkey')}, '%Y-%m-%d') || ' ' || lpad((l_suppkey % 24)::VARCHAR, 2, '0') || ':36' END AS t FROM lineitem),
p AS (SELECT *, 'BILLS-119hr' || k || code AS package FROM f WHERE ext <> '.doc')
SELECT package, '119:hr:' || k AS bill_id, code AS version_code, package || ext AS name, t AS newest FROM p QUALIFY row_number() OVER (PARTITION BY package ORDER BY t DESC NULLS LAST, ext DESC) = 1""")
def landed_listing(spark, sf_dir):
    """Listings of texts as JSON: the newest file of each package, undated ones the oldest, other kinds of files none."""
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    at = F.when(p % 7 != 0, text(F.date_format(day_of(p), "dd-MMM-yyyy"), " ", F.lpad((F.col("l_suppkey") % 24).cast("string"), 2, "0"), ":36")).otherwise("")
    one = F.struct(text("BILLS-119hr", k, picked(("ih", "eh1s", "enr"), p), picked((".xml", ".htm", ".doc"), F.col("l_linenumber"))).alias("name"), at.alias("formattedLastModifiedTime"))
    found = readers.text_listing(spark, put_pages(table(spark, sf_dir, "lineitem"), "listing", k, "files", one))
    return found.select("package", "bill_id", "version_code", "name", F.date_format("last_modified", "yyyy-MM-dd HH:mm").alias("newest"))


@query("SELECT '119:hr:' || (doc_id // 2) AS bill_id, CASE WHEN doc_id % 2 = 0 THEN 'ih' ELSE 'enr' END AS version_code, CASE WHEN doc_id % 2 = 0 THEN 'Introduced (House)' ELSE 'Enrolled' END AS version_label, (length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 0 ELSE 1 END)::INT AS line_count, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def text_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as a tree of folders with manifests, and read back from it."""
    k, root = F.col("doc_id"), scratch(spark, "tree")
    moment = F.lit("2025-01-02 10:00:00").cast("timestamp")
    code = F.when(k % 2 == 0, "ih").otherwise("enr")
    body = F.col("text")
    rows = table(spark, sf_dir, "documents").select(text("119:hr:", F.floor(k / 2).cast("long")).alias("bill_id"), code.alias("version_code"), code.alias("version_label"), body.alias("body"), F.lit(0).alias("line_count"), F.lit("").alias("sha256"), text("p", k).alias("package"), F.lit("u").alias("source_url"), moment.alias("last_modified"), moment.alias("fetched_at"))
    texttree.write_tree(rows, root)
    return readers.bill_texts(spark, root).select("bill_id", "version_code", "version_label", "line_count", F.sha2("body", 256).alias("sha256"))


@query("SELECT '119:hr:' || doc_id AS bill_id, 'ih' AS version_code, 'Introduced (House)' AS version_label, 2::INT AS line_count, sha256(coalesce(lang, 'none') || chr(10) || coalesce(source, 'none') || chr(10)) AS sha256, doc_id % 2 = 0 AS from_html FROM documents WHERE doc_id % 10 < 8")
def landed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed texts met with their landed bodies, HTML or else XML, without a printed page's furniture; those held already and those without a body aren't read."""
    k, none = F.col("doc_id"), F.lit("none")
    docs, root = table(spark, sf_dir, "documents"), scratch(spark, "bodies")
    package = text("BILLS-119hr", k, "ih")
    listing = readers.text_listing(spark, put_pages(docs, "listed", k, "files", F.struct(text(package, ".xml").alias("name"), F.lit("10-Jan-2025 20:36").alias("formattedLastModifiedTime"))))
    body = text("<html><body><pre>", F.coalesce("lang", none), "\n12\nPage 3\n", F.coalesce("source", none), "</pre></body></html>")
    bodies = docs.filter(k % 10 != 9).select(text(package, F.when(k % 2 == 0, ".htm").otherwise(".xml")).alias("name"), body.alias("body"))

    def write(batches):
        fs, at = texttree.opened(root)
        fs.create_dir(at)
        for rows in batches:
            for name, content in zip(rows["name"], rows["body"], strict=True):
                texttree.put_text(fs, f"{at}/{name}", content)
            yield rows[["name"]]

    bodies.mapInPandas(write, "name string").write.format("noop").mode("overwrite").save()
    held = docs.filter(k % 10 == 8).select(text("119:hr:", k).alias("bill_id"), F.lit("ih").alias("version_code"))
    frontier = spark.createDataFrame([], "slot string, last_modified timestamp")
    texts = readers.listed_texts(listing, root, held, frontier)[0]
    return texts.select("bill_id", "version_code", "version_label", "line_count", "sha256", F.endswith("source_url", F.lit(".htm")).alias("from_html"))
