"""Dimension queries: rosters, bills, roll calls, lobbying. Customers stand for members, orders for bills, lineitems for votes and mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.civic import any_of, congress_of_year, match_band, match_score, tokens
from ..schemas import table
from .registry import ORACLE_SQL, query

MONEY = "decimal(18,2)"


def members(spark, sf_dir) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    people = table(spark, sf_dir, "customer")
    return people.join(F.broadcast(places), people.c_nationkey == places.n_nationkey).select("c_custkey", "c_name", "c_acctbal", F.col("c_mktsegment").alias("party"), F.col("n_name").alias("state"), F.col("r_name").alias("chamber"))


def filtered(df: DataFrame, **equal) -> DataFrame:
    """df under a conjunction of equalities; those with None don't count."""
    for name, value in equal.items():
        df = df if value is None else df.filter(F.col(name) == value)
    return df


_MEMBERS = "(SELECT c_custkey, c_name, c_acctbal, c_mktsegment AS party, n_name AS state, r_name AS chamber FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"


@query(f"SELECT c_custkey, c_name, party, state, chamber FROM {_MEMBERS} WHERE chamber = 'EUROPE' AND party = 'BUILDING' AND contains(lower(c_name), '0') ORDER BY chamber, state, c_name LIMIT 500")
def roster_facets(spark, sf_dir):
    rows = filtered(members(spark, sf_dir), chamber="EUROPE", party="BUILDING", state=None).filter(F.lower("c_name").contains("0"))
    return rows.orderBy("chamber", "state", "c_name").limit(500).select("c_custkey", "c_name", "party", "state", "chamber")


_ROSTER = f"(SELECT m.*, bills FROM {_MEMBERS} m JOIN (SELECT o_custkey, count(*) AS bills FROM orders GROUP BY 1) o ON o.o_custkey = m.c_custkey WHERE chamber = 'ASIA' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = m.c_custkey AND o_orderkey % 30 < 20))"


@query(f"""SELECT party, members, in_debt, bills, top FROM (SELECT party, count(*) AS members, count(*) FILTER (c_acctbal < 0) AS in_debt, sum(bills)::BIGINT AS bills FROM {_ROSTER} GROUP BY party)
JOIN (SELECT party, string_agg(c_custkey || ':' || bills, ',' ORDER BY bills DESC, c_custkey) AS top FROM (SELECT * FROM {_ROSTER} QUALIFY row_number() OVER (PARTITION BY party ORDER BY bills DESC, c_custkey) <= 3) GROUP BY party) USING (party)""")
def roster_aggregate(spark, sf_dir):
    """Of a set of members, those on some committees, each party's numbers and its three most active."""
    orders = table(spark, sf_dir, "orders")
    bills = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("bills"))
    seated = orders.filter(F.col("o_orderkey") % 30 < 20).select(F.col("o_custkey").alias("c_custkey"))
    rows = filtered(members(spark, sf_dir), chamber="ASIA").join(seated, "c_custkey", "left_semi").join(bills, "c_custkey")
    numbers = rows.groupBy("party").agg(F.count("*").alias("members"), F.count_if(F.col("c_acctbal") < 0).alias("in_debt"), F.sum("bills").alias("bills"))
    return numbers.join(top_of(rows, "party", "bills", "c_custkey", 3), "party")


def top_of(rows: DataFrame, group: str, count: str, key: str, most: int) -> DataFrame:
    """(group, top): key:count of each group's rows with the highest counts, ties by key. A task keeps so many rows of a group before any are dealt."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(count), key))
    best = rows.select(group, count, key, place.alias("place")).filter(F.col("place") <= most)
    item = F.struct("place", F.concat_ws(":", F.col(key).cast("string"), F.col(count).cast("string")).alias("item"))
    return best.groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["item"]), ",").alias("top"))


@query("SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders WHERE o_orderpriority LIKE '%H%' AND o_orderstatus IN ('O', 'F') ORDER BY coalesce(o_orderdate, TIMESTAMP '1900-01-01') DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 50")
def bills_index_page2(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").contains("H") & F.col("o_orderstatus").isin("O", "F"))
    return rows.orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey").offset(50).limit(50).select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")


@query("SELECT count(*) AS bills, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_custkey) AS sponsors FROM orders WHERE o_orderpriority LIKE '%H%'")
def bills_aggregate(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").contains("H")).agg(F.count("*").alias("bills"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count_distinct("o_custkey").alias("sponsors"))


@query("SELECT DISTINCT o_orderpriority AS policy_area FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderpriority <> '' ORDER BY 1")
def policy_areas(spark, sf_dir):
    area = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").filter(area.isNotNull() & (area != "")).select(area.alias("policy_area")).distinct().orderBy("policy_area")


@query("SELECT o_orderkey, o_orderdate, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def sponsor_left_join(spark, sf_dir):
    sponsors = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, sf_dir, "orders").join(sponsors, "o_custkey", "left").select("o_orderkey", "o_orderdate", "c_name")


@query("SELECT t.l_orderkey, mentions, clients, o_orderdate FROM (SELECT l_orderkey, count(*) AS mentions, count(DISTINCT l_suppkey) AS clients FROM lineitem GROUP BY 1 ORDER BY mentions DESC, l_orderkey LIMIT 100) t JOIN orders ON o_orderkey = l_orderkey ORDER BY mentions DESC, t.l_orderkey LIMIT 25")
def most_lobbied(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("mentions"), F.count_distinct("l_suppkey").alias("clients"))
    top = per.orderBy(F.desc("mentions"), "l_orderkey").limit(100)  # four times what is asked for, as bills may be unknown
    bills = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return bills.join(F.broadcast(top), "l_orderkey").orderBy(F.desc("mentions"), "l_orderkey").limit(25).select("l_orderkey", "mentions", "clients", "o_orderdate")


@query("SELECT l_suppkey, min(s_name) AS name, count(*) AS filings, count(DISTINCT l_orderkey) AS bills, count(DISTINCT l_partkey) AS registrants, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS spent FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def client_profile(spark, sf_dir):
    """Each client's filings, bills, registrants and money: what repeats shrinks by (client, bill) and (client, registrant) before it is counted, so no row travels once per distinct count."""
    lines, money = table(spark, sf_dir, "lineitem"), F.col("l_extendedprice").cast(MONEY)
    by_bill = lines.groupBy("l_suppkey", "l_orderkey").agg(F.count("*").alias("filings"), F.sum(money).alias("spent"))
    per = by_bill.groupBy("l_suppkey").agg(F.sum("filings").alias("filings"), F.count("l_orderkey").alias("bills"), F.sum("spent").cast("double").alias("spent"))
    registrants = lines.select("l_suppkey", "l_partkey").distinct().groupBy("l_suppkey").agg(F.count("l_partkey").alias("registrants"))
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("name"))
    return per.join(registrants, "l_suppkey").join(names, "l_suppkey").select("l_suppkey", "filings", "bills", "registrants", "spent", "name")


@query("SELECT l_suppkey, l_orderkey, count(*) AS mentions, array_to_string(list_sort(list_distinct(list(l_returnflag || l_linestatus)))[1:6], ',') AS codes, min(o_orderstatus) AS status FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus <> 'P' GROUP BY 1, 2")
def client_bills(spark, sf_dir):
    codes = F.array_join(F.slice(F.sort_array(F.collect_set(F.concat("l_returnflag", "l_linestatus"))), 1, 6), ",")
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.count("*").alias("mentions"), codes.alias("codes"))
    bills = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("status"))
    return per.join(bills, "l_orderkey", "left").select("l_suppkey", "l_orderkey", "mentions", "codes", "status")


@query("SELECT l_suppkey, l_partkey, count(*) AS filings, max(year(l_shipdate))::INT AS last_year FROM lineitem GROUP BY 1, 2")
def client_registrants(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("filings"), F.year(F.max("l_shipdate")).alias("last_year"))


@query("SELECT l_suppkey, count(*) AS filings, coalesce(sum(l_extendedprice::DECIMAL(18,2)) FILTER (l_linenumber % 3 = 0), 0)::DOUBLE + coalesce(sum(l_extendedprice::DECIMAL(18,2)) FILTER (l_linenumber % 3 = 1 AND l_suppkey % 5 > 0), 0)::DOUBLE AS spent, count(DISTINCT year(l_shipdate) || ':' || quarter(l_shipdate)) AS periods FROM lineitem GROUP BY 1")
def client_totals(spark, sf_dir):
    """Each client's filings, income and expenses together, either of which may be missing from all of them, and periods."""
    kind, money = F.col("l_linenumber") % 3, F.col("l_extendedprice")
    income, expenses = F.when(kind == 0, money.cast(MONEY)), F.when((kind == 1) & (F.col("l_suppkey") % 5 > 0), money.cast(MONEY))
    period = F.concat_ws(":", F.year("l_shipdate").cast("string"), F.quarter("l_shipdate").cast("string"))
    known = lambda c: F.coalesce(F.sum(c).cast("double"), F.lit(0.0))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("filings"), (known(income) + known(expenses)).alias("spent"), F.count_distinct(period).alias("periods"))


@query("SELECT l_orderkey, coalesce(l_returnflag, 'all') AS party, count(*) FILTER (l_shipmode = 0) AS yea, count(*) FILTER (l_shipmode = 1) AS nay, count(*) FILTER (l_shipmode = 2) AS present, count(*) FILTER (l_shipmode > 2) AS not_voting, count(*) AS total FROM (SELECT *, l_linenumber % 4 AS l_shipmode FROM lineitem) GROUP BY ROLLUP (l_orderkey, l_returnflag) HAVING l_orderkey IS NOT NULL")
def rollcall_pivot(spark, sf_dir):
    place = F.col("l_linenumber") % 4
    votes = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("party"), place.alias("place"))
    tally = votes.rollup("l_orderkey", "party").agg(*[F.count_if(c).alias(n) for n, c in (("yea", F.col("place") == 0), ("nay", F.col("place") == 1), ("present", F.col("place") == 2), ("not_voting", F.col("place") > 2))], F.count("*").alias("total"))
    return tally.filter(F.col("l_orderkey").isNotNull()).withColumn("party", F.coalesce("party", F.lit("all")))


_MAJORITY = "SELECT l_orderkey, l_returnflag AS party, l_linestatus AS majority FROM (SELECT l_orderkey, l_returnflag, l_linestatus, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY count(*) DESC, min(l_linenumber), l_linestatus DESC) AS r FROM lineitem GROUP BY 1, 2, 3) WHERE r = 1"


def majorities(votes: DataFrame, call: str, party: str, position: str, place: str) -> DataFrame:
    """(call, party, majority): the most frequent position; of equally frequent ones that which comes first."""
    per = votes.groupBy(call, F.col(party).alias("party"), position).agg(F.count("*").alias("c"), F.min(place).alias("first"))
    return per.groupBy(call, "party").agg(F.max_by(position, F.struct("c", -F.col("first"), position)).alias("majority"))


@query(_MAJORITY)
def party_majority_mode(spark, sf_dir):
    return majorities(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber")


@query(f"SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l_returnflag AS party, CASE WHEN l_quantity > 2 THEN l_linestatus = majority END AS party_line FROM lineitem l JOIN ({_MAJORITY}) m ON m.l_orderkey = l.l_orderkey AND m.party = l.l_returnflag")
def party_line_flag(spark, sf_dir):
    votes = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("party"), "l_linestatus", "l_quantity")
    flagged = votes.join(majorities(votes, "l_orderkey", "party", "l_linestatus", "l_linenumber"), ["l_orderkey", "party"])
    return flagged.select("l_orderkey", "l_linenumber", "l_partkey", "party", F.when(F.col("l_quantity") > 2, F.col("l_linestatus") == F.col("majority")).alias("party_line"))


@query("SELECT p_brand, p_partkey, prio FROM (SELECT p_brand, p_partkey, prio, row_number() OVER (PARTITION BY p_brand ORDER BY prio, p_partkey) AS r FROM (SELECT *, CASE WHEN p_size >= 45 THEN 0 WHEN p_size >= 40 THEN 1 WHEN p_size >= 30 THEN 2 ELSE 3 END::INT AS prio FROM part)) WHERE r = 1")
def leadership_priority(spark, sf_dir):
    size = F.col("p_size")
    prio = F.when(size >= 45, 0).when(size >= 40, 1).when(size >= 30, 2).otherwise(3)
    return table(spark, sf_dir, "part").withColumn("prio", prio).groupBy("p_brand").agg(F.min(F.struct("prio", "p_partkey")).alias("m")).select("p_brand", "m.p_partkey", "m.prio")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE (lower(o_orderpriority) LIKE '%urgent%' OR lower(o_orderpriority) LIKE '%1%') OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F' AND l_quantity > 49)")
def semi_passed(spark, sf_dir):
    orders, area = table(spark, sf_dir, "orders"), F.lower("o_orderpriority")
    enrolled = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'F' AND l_quantity > 49").select("l_orderkey").distinct().withColumn("enrolled", F.lit(True))
    flagged = orders.join(enrolled, orders.o_orderkey == enrolled.l_orderkey, "left")
    return flagged.filter(any_of(area.contains("urgent"), area.contains("1"), F.coalesce("enrolled", F.lit(False)))).select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey AS bill FROM orders WHERE o_orderstatus = 'F' UNION SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def union_passed(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("bill")).union(table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey")).distinct()


@query("SELECT 'both' AS side, count(*) AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT user_id FROM events) UNION ALL SELECT 'orders', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT user_id FROM events)")
def set_operations(spark, sf_dir):
    a, b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "events").select(F.col("user_id").alias("k"))
    count = lambda df, side: df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return count(a.intersect(b), "both").union(count(a.distinct().join(b, "k", "left_anti"), "orders"))


@query("SELECT o_orderkey, o_orderdate::DATE AS day, r.name AS recess FROM orders JOIN (VALUES ('winter', 12, 20, 31), ('summer', 8, 1, 31), ('spring', 4, 5, 15)) r(name, m, a, b) ON month(o_orderdate) = r.m AND day(o_orderdate) BETWEEN r.a AND r.b")
def range_join_recess(spark, sf_dir):
    recess = spark.createDataFrame([("winter", 12, 20, 31), ("summer", 8, 1, 31), ("spring", 4, 5, 15)], "name string, m int, a int, b int")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return orders.join(F.broadcast(recess), (F.month("day") == F.col("m")) & F.dayofmonth("day").between(F.col("a"), F.col("b"))).select("o_orderkey", "day", F.col("name").alias("recess"))


@query("SELECT n_nationkey, y::INT AS y FROM nation CROSS JOIN range(1992, 2000) t(y) WHERE NOT EXISTS (SELECT 1 FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = n_nationkey AND year(o_orderdate) = y)")
def cross_missing_pairs(spark, sf_dir):
    wanted = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(1992), F.lit(1999))).alias("y"))
    nations = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    have = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y")).join(nations, "o_custkey").select("n_nationkey", "y").distinct()
    return wanted.join(have, ["n_nationkey", "y"], "left_anti")


@query("SELECT coalesce(a.k, b.k) AS nation, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def full_outer_sections(spark, sf_dir):
    a = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "nation", "full_outer").fillna(0, ["customers", "suppliers"])


@query("SELECT p_partkey, p_name, rank FROM (SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'part 12' THEN 0 WHEN starts_with(lower(p_name), 'part') AND contains(lower(p_name), '12') THEN 1 ELSE 2 END::INT AS rank FROM part WHERE contains(lower(p_name), '12') OR lower(p_brand) = 'brand#12') ORDER BY rank, p_name, p_partkey LIMIT 20")
def search_rank(spark, sf_dir):
    name, text = F.lower("p_name"), "12"
    hits = table(spark, sf_dir, "part").filter(any_of(name.contains(text), F.lower("p_brand") == f"brand#{text}"))
    rank = F.when(name == f"part {text}", 0).when(name.startswith("part") & name.contains(text), 1).otherwise(2)
    return hits.withColumn("rank", rank).orderBy("rank", "p_name", "p_partkey").limit(20).select("p_partkey", "p_name", "rank")


@query("SELECT n_name, parent, place FROM (SELECT n_name, r_name AS parent, row_number() OVER (ORDER BY r_name, n_name)::INT AS place FROM nation JOIN region ON r_regionkey = n_regionkey)")
def committee_nesting(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    nested = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select("n_name", F.col("r_name").alias("parent"))
    return nested.withColumn("place", F.row_number().over(Window.orderBy("parent", "n_name")))  # a dimension of a few hundred rows


@query("SELECT o_orderkey, round(coalesce(nullif(o_totalprice, 0), 0) / n, 6) AS amount_share FROM (SELECT o_orderkey, any_value(o_totalprice) AS o_totalprice, count(DISTINCT l_partkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)")
def amount_share(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_distinct("l_partkey").alias("n"))
    return table(spark, sf_dir, "orders").join(refs, "o_orderkey").select("o_orderkey", F.round(F.coalesce("o_totalprice", F.lit(0.0)) / F.col("n"), 6).alias("amount_share"))


@query("SELECT coalesce(o_orderpriority, 'all') AS tier, coalesce(o_orderstatus, 'all') AS model, count(*) AS bills, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS cost FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), ())")
def cost_rollup(spark, sf_dir):
    tier, model = F.col("o_orderpriority"), F.col("o_orderstatus")
    sums = table(spark, sf_dir, "orders").groupingSets([[tier], [model], []], tier, model).agg(F.count("*").alias("bills"), F.sum(F.col("o_totalprice").cast(MONEY)).cast("double").alias("cost"))
    return sums.select(F.coalesce(tier, F.lit("all")).alias("tier"), F.coalesce(model, F.lit("all")).alias("model"), "bills", "cost")


_TOK = "list_distinct(list_filter(list_transform(regexp_extract_all({}, '[A-Za-z][A-Za-z''-]+'), lambda w: lower(w)), lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'for')))"


@query(f"""WITH t AS (SELECT conv_id, turn, role, {_TOK.format("text")} AS ws FROM conversations),
s AS (SELECT a.conv_id, a.turn, a.ws AS title, b.ws AS mention, CASE WHEN a.turn % 3 = 0 THEN 1.0 WHEN a.turn % 3 = 1 THEN 0.5 ELSE 0.0 END AS issue FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
r AS (SELECT *, len(list_intersect(title, mention))::DOUBLE AS c, len(list_distinct(list_concat(title, mention))) AS u FROM s),
x AS (SELECT conv_id, turn, round(least(greatest(CASE WHEN len(mention) > 0 THEN 0.5 * coalesce(c / nullif(u, 0), 0) + 0.3 * coalesce(c / nullif(len(title), 0), 0) + 0.2 * issue ELSE 0.15 + 0.45 * issue END, 0), 1), 9)::DOUBLE AS score FROM r)
SELECT conv_id, turn, score, CASE WHEN score >= 0.6 THEN 'confident' WHEN score >= 0.3 THEN 'possible' ELSE 'false_positive' END AS band FROM x""")
def token_jaccard_score(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", tokens(F.col("text"), ("the", "and", "for")).alias("ws"))
    answers = said.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ws").alias("mention"))
    issue = F.when(F.col("turn") % 3 == 0, 1.0).when(F.col("turn") % 3 == 1, 0.5).otherwise(0.0)
    score = F.round(match_score(F.col("ws"), F.col("mention"), issue), 9)
    return said.join(answers, ["conv_id", "turn"]).select("conv_id", "turn", score.alias("score")).withColumn("band", match_band(F.col("score")))


def match_bands(spark, sf_dir):
    per = token_jaccard_score(spark, sf_dir).groupBy("band").agg(F.count("*").alias("n"))
    return per.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


query(f"SELECT band, n, round(100.0 * n / sum(n) OVER (), 6)::DOUBLE AS pct FROM (SELECT band, count(*) AS n FROM ({ORACLE_SQL['token_jaccard_score']}) GROUP BY band)")(match_bands)


@query("SELECT (119 + floor((year(o_orderdate) - 2025) / 2.0))::INT AS congress, count(*) AS bills FROM orders GROUP BY 1")
def congress_for_year(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(congress_of_year(F.year("o_orderdate")).alias("congress")).agg(F.count("*").alias("bills"))


@query("SELECT l_orderkey, string_agg(code, ',' ORDER BY l_linenumber, code) AS versions, first(code ORDER BY l_linenumber, code) AS first_version, last(code ORDER BY l_linenumber, code) AS last_version FROM (SELECT *, l_returnflag || l_linestatus AS code FROM lineitem) GROUP BY 1")
def ordered_array_agg(spark, sf_dir):
    """An order's versions by stage; the group is bounded by the number of versions of one bill."""
    version = F.struct("l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("code"))
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(version)).alias("v"))
    return per.select("l_orderkey", F.array_join("v.code", ",").alias("versions"), F.element_at("v.code", 1).alias("first_version"), F.element_at("v.code", -1).alias("last_version"))
