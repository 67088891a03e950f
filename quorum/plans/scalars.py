"""Functions of one value over whole columns: numbers, digests, addresses, terms, headings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import civic
from ..schemas import table
from ..text import clean
from .civics import picked
from .landed import text
from .registry import query


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN o_orderkey::INT END AS number FROM orders")
def leading_numbers(spark, sf_dir):
    """The number that a text as "2nd" or " 7" begins with; others have none."""
    k = F.col("o_orderkey")
    said = F.element_at(F.array(text(k, "nd"), text("  ", k), text(k), text("no ", k), F.lit("")), (k % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", civic.leading_int(said).alias("number"))


@query(r"""SELECT doc_id, substr(sha256('{"doc_id":' || doc_id || ',"lang":' || coalesce('"' || lang || '"', 'null') || ',"n_chars":' || coalesce(n_chars::VARCHAR, 'null') || ',"none":null,"note":"caf\u00e9 \"x\" \\ / \u2014\ud83d\ude00","source":' || coalesce('"' || source || '"', 'null') || '}'), 1, 16) AS digest FROM documents""")
def canonical_digests(spark, sf_dir):
    """Digests of rows in canonical JSON: fields by name, nulls kept, no blanks, all but ASCII escaped."""
    note = F.lit('café "x" \\ / —😀')
    return table(spark, sf_dir, "documents").select("doc_id", civic.content_hash(source=F.col("source"), lang=F.col("lang"), doc_id=F.col("doc_id"), n_chars=F.col("n_chars"), note=note, none=F.lit(None).cast("string")).alias("digest"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN '10.0.0.' || (user_id % 250) WHEN 1 THEN '2001:db8::' || (user_id % 250) END AS hop FROM events")
def first_hops(spark, sf_dir):
    """The first address of a list of forwarders; an empty one is none."""
    k, u = F.col("event_id"), F.col("user_id") % 250
    forwarded = F.when(k % 4 == 0, text("  10.0.0.", u, " , 10.1.1.1")).when(k % 4 == 1, text("2001:db8::", u)).when(k % 4 == 2, " , 10.1.1.1")
    return table(spark, sf_dir, "events").select("event_id", civic.first_hop(forwarded).alias("hop"))


@query("""WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS d, year(o_orderdate - INTERVAL 2 DAY) AS y FROM orders), b AS (SELECT *, make_date(CASE WHEN y % 2 = 1 THEN y ELSE y - 1 END, 1, 3) AS a FROM d)
SELECT o_orderkey, ((year(a) - 1789) // 2 + 1)::INT AS congress, CASE WHEN d < make_date(year(a) + 1, 1, 3) THEN 1 ELSE 2 END::INT AS session, datediff('day', a, d)::INT AS elapsed, round(100.0 * datediff('day', a, d) / datediff('day', a, make_date(year(a) + 2, 1, 3)), 1)::DOUBLE AS percent FROM b""")
def terms_of_days(spark, sf_dir):
    """The congress that sits on a bill's day, its session, and how much of its two years is over."""
    return table(spark, sf_dir, "orders").select("o_orderkey", civic.term_context(F.to_date("o_orderdate")).alias("t")).select("o_orderkey", "t.congress", "t.session", "t.elapsed", "t.percent")


@query("SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN 1 ELSE doc_id % 4 + 1 END::INT AS parts, CASE doc_id % 4 WHEN 0 THEN 'Be it enacted' WHEN 1 THEN 'Be it enacted' || chr(10) || 'SEC. 1. ' || coalesce(lang, '') ELSE 'SEC. ' || (doc_id % 4) || '. ' || coalesce(lang, '') END AS last FROM documents")
def headed_sections(spark, sf_dir):
    """Texts cut before lines that are headings; one with fewer than two is a whole."""
    k = F.col("doc_id")
    heads = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), k % 4), lambda i: i > 0), lambda i: text("\nSEC. ", i, ". ", F.coalesce("lang", F.lit(""))))
    parts = clean.sections(F.concat(F.lit("Be it enacted"), F.array_join(heads, "")), r"SEC\. \d+")
    return table(spark, sf_dir, "documents").select("doc_id", parts.alias("p")).select("doc_id", F.size("p").alias("parts"), F.element_at("p", -1).alias("last"))


RATINGS = ("R+5", " d + 12 ", "Even", "EV (since 2021)", "(R+1)", "I+3", "", "R+", "D+3 (-2)")


@query("SELECT o_orderkey, ['R+5', 'D+12', 'EVEN', 'EVEN', NULL, NULL, NULL, NULL, 'D+3'][o_orderkey % 9 + 1] AS label, [5, -12, 0, 0, NULL, NULL, NULL, NULL, -3][o_orderkey % 9 + 1]::INT AS score FROM orders")
def parsed_ratings(spark, sf_dir):
    """Ratings in their spellings; what isn't one is null."""
    return table(spark, sf_dir, "orders").select("o_orderkey", civic.pvi(picked(RATINGS, F.col("o_orderkey"))).alias("p")).select("o_orderkey", "p.label", "p.score")
