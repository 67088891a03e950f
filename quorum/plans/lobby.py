"""Lobbying mentions scored against the bills that they name: documents stand for bills, lineitems for mentions, whose texts are parts of the same or of another document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tables
from ..operators import matching
from ..schemas import table
from .civics import AREAS, CODES, _sql, bill_id, picked
from .registry import query

PERIODS = tuple(matching.PERIODS)


def lobbied_bills(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(bill_id(F.col("doc_id")).alias("bill_id"), F.substring("text", 1, 120).alias("title"), picked(AREAS, F.col("doc_id")).alias("policy_area"))


def mentions(spark, sf_dir) -> DataFrame:
    """Of five mentions two tell of the bill that they name, two of another one, one of nothing; some name bills that there aren't."""
    line = table(spark, sf_dir, "lineitem")
    about, kind = F.col("l_orderkey") % 1100, F.col("l_linenumber") % 5
    doc = F.when(kind < 2, about).when(kind < 4, F.col("l_partkey") % 1000).otherwise(-1 - F.col("l_orderkey"))  # those without one are dealt by other keys than one null
    said = line.select(bill_id(about).alias("bill_id"), F.col("l_suppkey").cast("string").alias("client_id"), F.concat(F.lit("client "), "l_suppkey").alias("client_name"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"), F.year("l_shipdate").alias("filing_year"),
                       picked(PERIODS, F.quarter("l_shipdate") - 1).alias("filing_period"), F.array(picked(CODES, F.col("l_linenumber")), picked(CODES, F.col("l_partkey"))).alias("issue_codes"), doc.alias("doc_id"), (F.col("l_linenumber") % 4 * 10 + 1).cast("int").alias("__from"), (kind < 4).alias("__told"))
    texts = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 130).alias("text"))  # a mention ends before
    told = F.when(F.col("__told"), F.substring("text", F.col("__from"), F.lit(90)))
    return said.join(texts.hint("shuffle_hash"), "doc_id", "left").withColumn("mention_text", F.coalesce(told, F.lit(""))).drop("doc_id", "text", "__from", "__told")


_WORDS = "list_distinct(list_filter(list_transform(regexp_extract_all(regexp_replace({}, '(?i)\\b(h\\.?\\s*r|s|h\\.?\\s*j\\.?\\s*res|s\\.?\\s*j\\.?\\s*res|h\\.?\\s*con\\.?\\s*res|s\\.?\\s*con\\.?\\s*res|h\\.?\\s*res|s\\.?\\s*res)\\.?\\s*\\d+\\b', ' ', 'g'), '[A-Za-z][A-Za-z''-]+'), lambda w: lower(w)), lambda w: length(w) > 2 AND NOT list_contains(stop, w)))"
_SCORED = f"""WITH stop AS (SELECT string_split('{" ".join(tables.STOP_WORDS)}', ' ') AS stop),
issues AS (SELECT map {{'TAX': ['Taxation'], 'ENV': ['Environmental Protection', 'Public Lands and Natural Resources'], 'INS': ['Finance and Financial Sector', 'Health'], 'HCR': ['Health'], 'FIN': ['Finance and Financial Sector'], 'DEF': ['Armed Forces and National Security'],
  'BNK': ['Finance and Financial Sector'], 'CHM': ['Environmental Protection', 'Health'], 'NAT': ['Public Lands and Natural Resources', 'Native Americans']}} AS issues),
b AS (SELECT doc_id, substr(text, 1, 120) AS title, {_sql(AREAS, "doc_id")} AS area FROM documents),
bw AS (SELECT doc_id, area, {_WORDS.format("title")} AS title FROM b, stop),
m AS (SELECT l_orderkey % 1100 AS k, l_suppkey::VARCHAR AS client_id, 'client ' || l_suppkey AS client_name, l_extendedprice::DECIMAL(18,2) AS amount, year(l_shipdate) AS y, quarter(l_shipdate) AS q, [{_sql(CODES, "l_linenumber")}, {_sql(CODES, "l_partkey")}] AS codes,
  coalesce(substr(d.text, (l_linenumber % 4 * 10 + 1)::INT, 90), '') AS mention FROM lineitem LEFT JOIN documents d ON d.doc_id = CASE WHEN l_linenumber % 5 < 2 THEN l_orderkey % 1100 WHEN l_linenumber % 5 < 4 THEN l_partkey % 1000 END),
mw AS (SELECT m.*, {_WORDS.format("mention")} AS ws FROM m, stop),
j AS (SELECT mw.*, coalesce(title, []) AS title, CASE WHEN coalesce(area, '') = '' OR len(flatten(list_transform(codes, lambda c: coalesce(issues[c], [])))) = 0 THEN 0.5 WHEN list_contains(flatten(list_transform(codes, lambda c: coalesce(issues[c], []))), area) THEN 1.0 ELSE 0.0 END::DOUBLE AS issue FROM mw LEFT JOIN bw ON doc_id = k, issues),
r AS (SELECT *, len(list_intersect(title, ws))::DOUBLE AS common, len(list_distinct(list_concat(title, ws))) AS all_of FROM j),
s AS (SELECT *, len(ws) > 0 AS has_mention, least(greatest(CASE WHEN len(ws) > 0 THEN 0.5::DOUBLE * coalesce(common / nullif(all_of, 0), 0) + 0.3::DOUBLE * coalesce(common / nullif(len(title), 0), 0) + 0.2::DOUBLE * issue ELSE 0.15::DOUBLE + 0.45::DOUBLE * issue END, 0), 1) AS score FROM r),
x AS (SELECT *, '119:' || ['hr', 's', 'hconres'][k % 3 + 1] || ':' || k AS bill_id, CASE WHEN score >= 0.6::DOUBLE THEN 'confident' WHEN score >= 0.3::DOUBLE THEN 'possible' ELSE 'false_positive' END AS band FROM s) """


@query(_SCORED + """, p AS (SELECT bill_id, client_id, any_value(client_name) AS client_name, count(*) AS filings, sum(amount)::DOUBLE AS amount, max(y * 10 + q) AS w, max(score) AS best, array_to_string(list_sort(list_distinct(flatten(list(codes))))[1:6], ',') AS codes FROM x GROUP BY bill_id, client_id HAVING max(score) >= 0.3::DOUBLE)
SELECT bill_id, client_id, client_name, filings, amount, (w // 10) || ' Q' || (w % 10) AS latest_period, codes, round(best, 9)::DOUBLE AS best, CASE WHEN best >= 0.6::DOUBLE THEN 'confident' ELSE 'possible' END AS band, (row_number() OVER (PARTITION BY bill_id ORDER BY filings DESC, amount DESC NULLS LAST, client_id))::INT AS place FROM p QUALIFY place <= 10""")
def top_clients_for_bill(spark, sf_dir):
    """Each bill's ten clients with the most filings, of those that have one that fits."""
    shown = matching.clients_of_bills(matching.scored(mentions(spark, sf_dir), lobbied_bills(spark, sf_dir)))
    return shown.withColumns({"codes": F.array_join("issue_codes", ","), "best": F.round("best", 9)}).drop("issue_codes")


@query(_SCORED + "SELECT band, count(*) AS n, count(*) FILTER (has_mention) AS with_mention, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS pct FROM x GROUP BY band")
def mention_bands(spark, sf_dir):
    """How many mentions fit their bills, may fit, or don't."""
    return matching.bands(matching.scored(mentions(spark, sf_dir), lobbied_bills(spark, sf_dir)))


@query(_SCORED + """, t AS (SELECT bill_id, count(*) AS n FROM x WHERE band = 'false_positive' GROUP BY 1 ORDER BY n DESC, bill_id LIMIT 10)
SELECT bill_id, n, client_name, substr(mention, 1, 80) AS snippet, (row_number() OVER (PARTITION BY bill_id ORDER BY client_name, mention))::INT AS example FROM x JOIN t USING (bill_id) WHERE band = 'false_positive' QUALIFY example <= 3""")
def false_positives(spark, sf_dir):
    """The bills with the most mentions that don't fit, with three examples each."""
    return matching.misfits(matching.scored(mentions(spark, sf_dir), lobbied_bills(spark, sf_dir)), ["client_name", "mention_text"])
