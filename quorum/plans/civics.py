"""Bills, votes, members, filings and views with texts, labels, agents and titles as they come: the driver's tables supply keys, dates and amounts, and lists of realistic values the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import civic, tables
from ..operators import search
from ..schemas import table
from ..sources import ratings, readers
from ..streaming import cursors
from .registry import query

# (code, type, text) of actions; agents; paths; titles; issue codes; policy areas; sources of a photo.
ACTIONS = (
    ("INTROH", "IntroReferral", "Introduced in House"), ("1000", "", "Introduced in House"), ("H11100", "IntroReferral", "Referred to the Committee on Ways and Means."), ("5000", "Committee", "Ordered to be Reported."), ("", "Calendars", "Placed on the calendar. Reported by the chair."),
    ("H8D000", "Floor", "DEBATE - The House proceeded with one hour of debate."), ("H30000", "", "Rule H. Res. 5 provides for it."), ("", "", "On passage Passed by voice vote."), ("", "", "Resolving differences: Senate agreed to the conference report."), ("E20000", "President", "Presented to President."),
    ("", "President", "Vetoed by President."), ("36000", "BecameLaw", "Became Public Law No: 119-1."), ("", "President", "Signed by President."), ("", "", "Message on Senate action sent to the House."), ("8000", "", "Markup held"), ("", "", "Sponsor introductory remarks"),
)
UAS = ("Mozilla/5.0 (compatible; Googlebot/2.1)", "Mozilla/5.0 Chrome/120 Safari", "curl/8.1", "", "GPTBot/1.0", "Mozilla/5.0 Firefox/118", "PerplexityBot/1.0", "SomeCrawler/3", "python-requests/2", "Slackbot-LinkExpanding 1.0", "Mozilla/5.0 HeadlessChrome/119", "ClaudeBot/1.0", "Mozilla/5.0 (iPhone) Safari")
PATHS = ("/", "/bill/119:hr:1", "/wp-admin/setup", "/api/events", "/members", "/.env", "/static/x.css", "/robots.txt", "/stats", "/phpmyadmin", "/docs/intro", "/wp-adminish", "/.env.local", "/SETUP.php", "/setup-guide", "/vendor/phpunit/x", "/backup.zip", "/ews/", "/ews//x", "/wp-json")
TITLES = ("Chair", "", "Ranking Member", "Vice Chair", "Chairwoman", "Member", "Chairman", " ranking ", "Ranking Minority Member", "Vice Ranking Member", "Cochair")
CODES = ("TAX", "ENV", "INS", "XXX", "HCR", "FIN", "DEF", "BNK", "CHM", "NAT")
AREAS = ("Taxation", "Health", "", "Environmental Protection", "Energy", "Finance and Financial Sector", "Public Lands and Natural Resources")
STATES = ("AL", "DC", "CA", "PR", "TX", "NY", "GU", "OH", "AS")


def picked(values: tuple[str, ...], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def _sql(values: tuple[str, ...], key: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][({key}) % {len(values)} + 1]"


_TYPE = _sql(("hr", "s", "hconres"), "{0}")
_BILL = f"'119:' || {_TYPE} || ':' || {{0}}"
_TITLE = _sql(TITLES, "o_orderkey")


def bill_type(key: Column) -> Column:
    return picked(("hr", "s", "hconres"), key)


def bill_id(key: Column) -> Column:
    return F.concat(F.lit("119:"), bill_type(key), F.lit(":"), key.cast("string"))


def votes(spark, sf_dir) -> DataFrame:
    """(label, chamber, rollcall, member, party, position): votes under the labels that roll calls carry."""
    k = F.col("l_orderkey")
    label = F.concat(picked(("H R ", "S. ", "H. Con. Res. "), k), k.cast("string"))
    return table(spark, sf_dir, "lineitem").select(label.alias("label"), F.when(F.col("l_linestatus") == "F", "senate").otherwise("house").alias("chamber"), (F.col("l_partkey") % 3 + 1).cast("int").alias("rollcall"), F.col("l_suppkey").alias("member"), F.col("l_returnflag").alias("party"), picked(("Yea", "Nay", "Present", "Not Voting"), F.col("l_linenumber")).alias("position"))


def bills(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(bill_id(k).alias("bill_id"), bill_type(k).alias("bill_type"), k.alias("number"), F.col("o_custkey").alias("sponsor"), F.to_date("o_orderdate").alias("introduced"), picked(AREAS, k).alias("policy_area"), F.col("o_totalprice").alias("amount"))


def log(spark, sf_dir) -> DataFrame:
    """(entity_id, event_type, occurred_at, payload): cosponsors and mentions of bills as events with JSON payloads."""
    line = table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    payload = F.to_json(F.struct(bill_id(k).alias("bill_id"), F.col("l_partkey").alias("filing"), F.col("l_extendedprice").alias("amount")))
    entity = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("bioguide:M"), "l_suppkey")).otherwise(F.concat(F.lit("bill:"), bill_id(k)))
    return line.select(entity.alias("entity_id"), F.when(F.col("l_linestatus") == "F", "bill.cosponsored").otherwise("bill_lobbied").alias("event_type"), F.col("l_shipdate").alias("occurred_at"), payload.alias("payload"))


def assignments(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("member"), (k % 30).alias("committee"), picked(TITLES, k).alias("title"))


def views(spark, sf_dir) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("ts", "user_id", picked(UAS, k).alias("ua"), picked(PATHS, F.floor(k / 13).cast("long")).alias("path"))


_VIEWS = f"(SELECT ts, user_id, {_sql(UAS, 'event_id')} AS ua, {_sql(PATHS, 'event_id // 13')} AS path FROM events)"
_BOT = "(ua = '' OR regexp_matches(ua, '(?i)(bot|crawler|spider|wget|curl|python-requests|httpx|aiohttp|yandex|facebookexternalhit|whatsapp|telegram|discord|preview|monitor|uptime|pingdom|datadog|newrelic|semrush|ahrefs|seekport|headlesschrome)'))"
# what only scanners ask for, as one pattern; the columns' list is in functions.tables
_PROBE = r"""regexp_matches(path, '(?i)^/(wp-(admin|login|content|includes|json|config)|xmlrpc\.php|\.(env|git|aws|ssh|svn|htaccess|DS_Store)|(phpmy|my)admin|pma|adminer|mysql|administrator|joomla|drupal|magento|vendor/phpunit|f?cgi-bin|actuator|server-(status|info)|(shell|cmd|c99|r57|config|configuration|install)\.php|webshell|backup\.(zip|tar)|(database|dump)\.sql|owa|exchange|autodiscover|ews/|console|jenkins|kibana|elastic|laravel|symfony|_ignition|telescope/|horizon/|setup|installer)(/|\.|$)')"""


_TALLY = f"""SELECT {_BILL.format("l_orderkey")} AS bill_id, CASE l_linestatus WHEN 'F' THEN 'senate' ELSE 'house' END AS chamber, (l_partkey % 3 + 1)::INT AS rollcall, {{}} AS party, count(*) FILTER (p = 0) AS yea, count(*) FILTER (p = 1) AS nay, count(*) FILTER (p = 3) AS missed
FROM (SELECT *, l_linenumber % 4 AS p FROM lineitem) JOIN customer ON c_custkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL"""


@query(_TALLY.format("l_returnflag") + " UNION ALL " + _TALLY.format("'all'"))
def bill_rollcalls(spark, sf_dir):
    """Each roll call on a bill, by party and in all: roll calls meet their bills by the type and number that their labels tell, voters the members; a call is told by chamber and number."""
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("member"))
    # exploded, so a label is read once a vote: conditions on what it tells aren't moved before it
    said = votes(spark, sf_dir).select("*", F.explode(F.array(civic.bill_of_label(F.col("label")))).alias("b")).select("*", "b.bill_type", F.col("b.number").cast("long").alias("number")).drop("b", "label")
    met = said.join(bills(spark, sf_dir).select("bill_id", "bill_type", "number"), ["bill_type", "number"]).join(known, "member")
    at, call = F.col("position"), ["bill_id", "chamber", "rollcall"]
    per = met.groupBy(*call, "party").agg(F.count_if(at == "Yea").alias("yea"), F.count_if(at == "Nay").alias("nay"), F.count_if(at == "Not Voting").alias("missed"))
    whole = per.groupBy(*call).agg(*[F.sum(c).alias(c) for c in ("yea", "nay", "missed")]).withColumn("party", F.lit("all"))
    return per.unionByName(whole)


_STAGE = """CASE WHEN contains(lower(t), 'intro') OR c IN ('INTROH', 'INTROS', '1000') THEN 'introduced' WHEN regexp_matches(lower(t), 'became(public|private)?law') OR contains(lower(x), 'signed by president') THEN 'signed'
WHEN contains(lower(x), 'vetoed') OR contains(lower(t), 'veto') THEN 'vetoed' WHEN contains(lower(x), 'to president') THEN 'sent' WHEN regexp_matches(lower(x), 'passed|agreed to') OR contains(lower(t), 'passed') THEN 'passed'
WHEN contains(lower(t), 'committee') OR regexp_matches(lower(x), 'referred|reported|markup') THEN 'committee' WHEN contains(lower(t), 'floor') OR regexp_matches(lower(x), 'consideration by|rule') THEN 'floor' ELSE 'other' END"""
_ACTION = ", ".join(_sql(tuple(a[i] for a in ACTIONS), "l_linenumber * 7 + l_partkey") + f" AS {n}" for i, n in enumerate("ctx"))


@query(f"SELECT l_orderkey, stage, count(*) AS n, min(l_shipdate) AS first_at FROM (SELECT *, {_STAGE} AS stage FROM (SELECT l_orderkey, l_shipdate, {_ACTION} FROM lineitem)) GROUP BY ALL")
def bill_stages(spark, sf_dir):
    """A bill's actions by stage, told by code, type and text."""
    key = F.col("l_linenumber") * 7 + F.col("l_partkey")
    code, kind, text = (picked(tuple(a[i] for a in ACTIONS), key) for i in range(3))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", tables.stage(code, kind, text).alias("stage")).agg(F.count("*").alias("n"), F.min("l_shipdate").alias("first_at"))


@query("SELECT agent, count(*) AS views FROM (SELECT CASE " + " ".join(f"WHEN ua ILIKE '%{w}%' THEN '{n}'" for w, n in tables.AGENTS) + f" ELSE 'other-bot' END AS agent FROM {_VIEWS} WHERE {_BOT}) GROUP BY 1 ORDER BY views DESC, agent LIMIT 20")
def top_bots(spark, sf_dir):
    return views(spark, sf_dir).filter(tables.is_bot(F.col("ua"))).groupBy(tables.agent_name(F.col("ua")).alias("agent")).agg(F.count("*").alias("views")).orderBy(F.desc("views"), "agent").limit(20)


@query(f"SELECT path, {_BOT} OR {_PROBE} AS bot, {_PROBE} AS probe, count(*) AS views, count(DISTINCT user_id) AS visitors FROM {_VIEWS} WHERE NOT (path IN ('/robots.txt', '/sitemap.xml', '/favicon.ico', '/stats') OR regexp_matches(path, '^(/static/|/api/|/photo/|/docs|/openapi.json)')) GROUP BY ALL")
def page_views(spark, sf_dir):
    """Views by path: what isn't a page is left out, scanners' paths are bots' whatever the agent."""
    path = F.col("path")
    bot = tables.is_bot(F.col("ua")) | tables.is_probe(path)
    return views(spark, sf_dir).filter(~tables.is_skipped(path)).groupBy("path", bot.alias("bot"), tables.is_probe(path).alias("probe")).agg(F.count("*").alias("views"), F.count_distinct("user_id").alias("visitors"))


def page_view_rows(df: DataFrame) -> DataFrame:
    """Rows as the table of views takes them: long paths, methods, hosts and agents are cut, an agent that is missing is empty."""
    cut = lambda c, n: F.substring(F.col(c), 1, n).alias(c)
    return df.select("ts", cut("path", 2000), F.col("status").cast("smallint").alias("status"), cut("method", 8), F.nullif(F.substring("referer_host", 1, 255), F.lit("")).alias("referer_host"), F.substring(F.coalesce("ua", F.lit("")), 1, 500).alias("ua"),
                     tables.is_bot(F.col("ua")).alias("is_bot"), "visitor_hash", F.col("dur_ms").cast("int").alias("dur_ms"))


@query("SELECT doc_id AS view, substr(text, 1, 2000) AS path, 200::SMALLINT AS status, substr(lang || 'POSTPOST', 1, 8) AS method, nullif(substr(coalesce(source, ''), 1, 255), '') AS referer_host, substr(text, 1, 500) AS ua FROM documents")
def page_view_append(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit(None).cast("timestamp").alias("ts"), F.col("text").alias("path"), F.lit(200).alias("status"), F.concat("lang", F.lit("POSTPOST")).alias("method"), F.coalesce("source", F.lit("")).alias("referer_host"), F.col("text").alias("ua"), F.col("doc_id").cast("string").alias("visitor_hash"), F.lit(1).alias("dur_ms"))
    return page_view_rows(docs).select(F.col("visitor_hash").cast("long").alias("view"), "path", "status", "method", "referer_host", "ua")


_ISSUES = """(VALUES ('TAX', 'Taxation'), ('ENV', 'Environmental Protection'), ('ENV', 'Public Lands and Natural Resources'), ('INS', 'Finance and Financial Sector'), ('INS', 'Health'), ('HCR', 'Health'), ('FIN', 'Finance and Financial Sector'), ('DEF', 'Armed Forces and National Security'),
('BNK', 'Finance and Financial Sector'), ('CHM', 'Environmental Protection'), ('CHM', 'Health'), ('NAT', 'Public Lands and Natural Resources'), ('NAT', 'Native Americans')) i(code, area)"""
_CODES = f"[{_sql(CODES, 'l_linenumber')}, {_sql(CODES, 'l_partkey')}]"


@query(f"""WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, {_CODES} AS codes, {_sql(AREAS, "l_orderkey")} AS area FROM lineitem),
e AS (SELECT DISTINCT codes, list(i.area) AS areas FROM (SELECT DISTINCT codes FROM m) s, {_ISSUES} WHERE list_contains(s.codes, i.code) GROUP BY codes)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN area = '' OR areas IS NULL THEN 0.5 WHEN list_contains(areas, area) THEN 1.0 ELSE 0.0 END::DOUBLE AS fit FROM m LEFT JOIN e USING (codes)""")
def issue_policy_fit(spark, sf_dir):
    codes = F.array(picked(CODES, F.col("l_linenumber")), picked(CODES, F.col("l_partkey")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", tables.issue_fit(codes, picked(AREAS, F.col("l_orderkey"))).alias("fit"))


@query(f"""WITH p AS (SELECT o_custkey AS member, o_orderkey % 30 AS committee, lower({_TITLE}) AS t, (o_orderkey % 30) % 2 = 1 AS sub FROM orders),
r AS (SELECT *, CASE WHEN t IN ('chair', 'chairman', 'chairwoman') THEN CASE WHEN sub THEN 3 ELSE 1 END WHEN trim(t) IN ('ranking member', 'ranking minority member', 'ranking') THEN CASE WHEN sub THEN 4 ELSE 2 END END AS prio FROM p)
SELECT member, committee, prio::INT AS prio, ['chair', 'ranking', 'subchair', 'subranking'][prio] AS role FROM (SELECT *, row_number() OVER (PARTITION BY member ORDER BY prio, committee) AS n FROM r WHERE prio IS NOT NULL) WHERE n = 1""")
def leading_roles(spark, sf_dir):
    """Each member's highest role: of a full committee before a subcommittee's, chairs before ranking members; vice chairs are none."""
    kind, sub = tables.leading_class(F.col("title")), F.col("committee") % 2 == 1
    prio = F.when(kind == "chair", F.when(sub, 3).otherwise(1)).when(kind == "ranking", F.when(sub, 4).otherwise(2))
    led = assignments(spark, sf_dir).withColumn("prio", prio).filter("prio IS NOT NULL").groupBy("member").agg(F.min(F.struct("prio", "committee")).alias("m"))
    return led.select("member", "m.committee", "m.prio", picked(("chair", "ranking", "subchair", "subranking"), F.col("m.prio") - 1).alias("role"))


@query(f"SELECT o_custkey AS member, o_orderkey % 30 AS committee, {_TITLE} AS title, n_name AS name, r_name AS parent FROM orders LEFT JOIN nation ON n_nationkey = o_orderkey % 30 LEFT JOIN region ON r_regionkey = n_regionkey")
def member_committees(spark, sf_dir):
    """Assignments with their committee and its parent; those of unknown committees stay."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    known = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(F.col("n_nationkey").alias("committee"), F.col("n_name").alias("name"), F.col("r_name").alias("parent"))
    return assignments(spark, sf_dir).join(F.broadcast(known), "committee", "left").select("member", "committee", "title", "name", "parent")


_FUND = "(SELECT o_custkey, (year(o_orderdate) + year(o_orderdate) % 2)::INT AS cycle, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS receipts FROM orders GROUP BY ALL)"


@query(f"SELECT o_custkey AS member, cycle, receipts, (row_number() OVER (PARTITION BY o_custkey ORDER BY cycle DESC))::INT AS place FROM {_FUND}")
def funding_rows(spark, sf_dir):
    """A member's totals by two-year cycle, the newest first."""
    year = F.year("o_orderdate")
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("member"), (year + year % 2).alias("cycle")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("receipts"))
    return per.withColumn("place", F.row_number().over(Window.partitionBy("member").orderBy(F.desc("cycle"))))


def district_ratings(spark, sf_dir) -> DataFrame:
    """(congress, state, district, pvi, score): suppliers' balances stand for the ratings of their nation's districts; -1 is the nation's own."""
    k = F.col("s_suppkey")
    per = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("state"), (k % 4 - 1).cast("int").alias("district")).agg((F.floor(F.max("s_acctbal") / 1000) - 4).cast("int").alias("score"))
    return per.select(F.lit(civic.CONGRESS).alias("congress"), "state", "district", civic.pvi_label(F.col("score").cast("double")).alias("pvi"), "score")


def rated_members(spark, sf_dir) -> DataFrame:
    """(member, district, chamber, state, pvi, score): all members, those of places without a rating with nulls."""
    k = F.col("c_custkey")
    people = table(spark, sf_dir, "customer").select(k.alias("member"), F.nullif(k % 4, F.lit(3)).cast("int").alias("district"), F.when(F.col("c_mktsegment") == "BUILDING", "Senate").otherwise("House").alias("chamber"), F.col("c_nationkey").cast("string").alias("state"))
    return ratings.rated(people, district_ratings(spark, sf_dir), civic.CONGRESS)


_RATED = """SELECT c_custkey AS member, r.score, CASE WHEN score = 0 THEN 'EVEN' WHEN score > 0 THEN 'R+' || score ELSE 'D+' || (-score) END AS pvi, (CASE WHEN c_mktsegment = 'BUILDING' THEN -1 ELSE coalesce(nullif(c_custkey % 4, 3), 0) END)::INT AS place
FROM customer LEFT JOIN (SELECT s_nationkey, s_suppkey % 4 - 1 AS d, (floor(max(s_acctbal) / 1000) - 4)::INT AS score FROM supplier GROUP BY 1, 2) r ON s_nationkey = c_nationkey AND d = CASE WHEN c_mktsegment = 'BUILDING' THEN -1 ELSE coalesce(nullif(c_custkey % 4, 3), 0) END"""


@query(f"SELECT member AS c_custkey, place AS district, pvi, score FROM ({_RATED})")
def pvi_score_join(spark, sf_dir):
    """Ratings by state and district: senators have their state's, members at large district 0; those of places without a rating none."""
    at = civic.district_key(F.lower("chamber"), F.col("district"))
    return rated_members(spark, sf_dir).select(F.col("member").alias("c_custkey"), at.alias("district"), "pvi", "score")


@query(f"SELECT l_orderkey AS o_orderkey, rated, avg_rating, CASE WHEN r = 0 THEN 'EVEN' WHEN r > 0 THEN 'R+' || r ELSE 'D+' || (-r) END AS label FROM (SELECT l_orderkey, rated, avg_rating, round_even(avg_rating, 0)::INT AS r FROM (SELECT l_orderkey, count(*) AS rated, sum(score)::DOUBLE / count(*) AS avg_rating FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN ({_RATED}) ON member = l_suppkey WHERE score IS NOT NULL GROUP BY 1))")
def cosponsor_rating(spark, sf_dir):
    """The mean rating of a bill's cosponsors that have one."""
    known = rated_members(spark, sf_dir).filter("score IS NOT NULL").select(F.col("member").alias("l_suppkey"), "score")
    by = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct().join(known, "l_suppkey")
    per = by.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("rated"), (F.sum("score").cast("double") / F.count("*")).alias("avg_rating"))
    return per.withColumn("label", civic.pvi_label(F.col("avg_rating")))


def _profile(spark, sf_dir) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("member"), "c_name", picked(STATES, F.col("c_nationkey")).alias("state"))
    seats = member_committees(spark, sf_dir).groupBy("member").agg(F.count("*").alias("seats"), F.count("name").alias("known_seats"))
    latest = funding_rows(spark, sf_dir).filter("place = 1").select("member", F.col("cycle").alias("latest_cycle"), "receipts")
    role = leading_roles(spark, sf_dir).select("member", "role")
    rating = rated_members(spark, sf_dir).select("member", "pvi")
    handle = table(spark, sf_dir, "pages").select(F.col("page_id").alias("member"), F.col("url").alias("handle"))
    people = people.join(rating, "member", "left").join(handle, "member", "left")
    return people.join(seats, "member", "left").join(role, "member", "left").join(latest, "member", "left").fillna(0, ["seats", "known_seats"])


@query(f"""SELECT c_custkey AS member, c_name, {_sql(STATES, "c_nationkey")} AS state, coalesce(s.seats, 0) AS seats, coalesce(s.known, 0) AS known_seats, r.role, f.cycle AS latest_cycle, f.receipts, v.pvi, p.url AS handle FROM customer
LEFT JOIN ({_RATED}) v ON v.member = c_custkey LEFT JOIN pages p ON page_id = c_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS seats, count(*) FILTER (o_orderkey % 30 < 25) AS known FROM orders GROUP BY 1) s ON s.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, arg_max(cycle, cycle) AS cycle, arg_max(receipts, cycle) AS receipts FROM {_FUND} GROUP BY 1) f ON f.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, ['chair', 'ranking', 'subchair', 'subranking'][min(CASE WHEN lower({_TITLE}) IN ('chair', 'chairman', 'chairwoman') THEN CASE WHEN (o_orderkey % 30) % 2 = 1 THEN 3 ELSE 1 END WHEN trim(lower({_TITLE})) IN ('ranking member', 'ranking minority member', 'ranking') THEN CASE WHEN (o_orderkey % 30) % 2 = 1 THEN 4 ELSE 2 END END)] AS role FROM orders GROUP BY 1) r ON r.o_custkey = c_custkey""")
def member_profiles(spark, sf_dir):
    """All members' profiles at once: seats, role, rating, address, and the totals of the latest cycle."""
    return _profile(spark, sf_dir)


@query(f"SELECT c_custkey AS member, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 30 = 4)")
def committee_members(spark, sf_dir):
    seats = assignments(spark, sf_dir).filter("committee = 4").select("member")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("member"), "c_name").join(seats, "member", "left_semi")


@query(f"SELECT count(*) FILTER (s NOT IN ('DC', 'PR', 'VI', 'GU', 'AS', 'MP')) AS voting, count(*) FILTER (s IN ('DC', 'PR', 'VI', 'GU', 'AS', 'MP')) AS delegates, greatest(0, 435 - count(*) FILTER (s NOT IN ('DC', 'PR', 'VI', 'GU', 'AS', 'MP')))::BIGINT AS vacancies FROM (SELECT {_sql(STATES, 'c_nationkey')} AS s FROM customer WHERE c_mktsegment <> 'BUILDING')")
def house_seats(spark, sf_dir):
    """Voting members, delegates of places without a vote, and seats that are empty."""
    delegate = picked(STATES, F.col("c_nationkey")).isin(*tables.DELEGATES)
    n = table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'").agg(F.count_if(~delegate).alias("voting"), F.count_if(delegate).alias("delegates"))
    return n.withColumn("vacancies", F.greatest(F.lit(0).cast("long"), 435 - F.col("voting")))


_LOG = f"(SELECT *, CASE l_linestatus WHEN 'F' THEN 'bioguide:M' || l_suppkey ELSE 'bill:' || {_BILL.format('l_orderkey')} END AS entity_id, {_BILL.format('l_orderkey')} AS bill_id FROM lineitem)"


@query(f"SELECT entity_id, count(*) AS n, max(l_shipdate) AS last_at FROM {_LOG} WHERE starts_with(entity_id, 'bioguide:') GROUP BY 1")
def members_of_log(spark, sf_dir):
    return log(spark, sf_dir).filter(F.col("entity_id").startswith("bioguide:")).groupBy("entity_id").agg(F.count("*").alias("n"), F.max("occurred_at").alias("last_at"))


@query(f"SELECT entity_id, l_linestatus = 'F' AS cosponsor, count(*) AS n FROM {_LOG} WHERE entity_id IN ('bioguide:M1', 'bioguide:M3', 'bioguide:M7', 'bill:119:hr:3', 'bill:119:s:7') GROUP BY ALL")
def log_of_ids(spark, sf_dir):
    wanted = ["bioguide:M1", "bioguide:M3", "bioguide:M7", "bill:119:hr:3", "bill:119:s:7"]
    return log(spark, sf_dir).filter(F.col("entity_id").isin(wanted)).groupBy("entity_id", (F.col("event_type") == "bill.cosponsored").alias("cosponsor")).agg(F.count("*").alias("n"))


@query(f"SELECT bill_id, s_name AS name, l_shipdate AS at FROM {_LOG} JOIN supplier ON 'bioguide:M' || s_suppkey = entity_id WHERE l_linestatus = 'F'")
def cosponsors(spark, sf_dir):
    """Cosponsors of each bill with their names."""
    people = table(spark, sf_dir, "supplier").select(F.concat(F.lit("bioguide:M"), "s_suppkey").alias("entity_id"), F.col("s_name").alias("name"))
    seen = log(spark, sf_dir).filter("event_type = 'bill.cosponsored'").select("entity_id", F.get_json_object("payload", "$.bill_id").alias("bill_id"), F.col("occurred_at").alias("at"))
    return seen.join(people, "entity_id").select("bill_id", "name", "at")


@query(f"SELECT {_sql(AREAS, 'o_orderkey')} AS policy_area, count(*) AS mentions, count(DISTINCT l_partkey) AS filings, round(sum(l_extendedprice), 2) AS amount FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus <> 'F' GROUP BY 1")
def lobbied_areas(spark, sf_dir):
    """Mentions meet their bills by the id in their payload."""
    field = lambda f: F.get_json_object("payload", f"$.{f}")
    seen = log(spark, sf_dir).filter("event_type = 'bill_lobbied'").select(field("bill_id").alias("bill_id"), field("filing").try_cast("long").alias("filing"), field("amount").try_cast("double").alias("amount"))
    return seen.join(bills(spark, sf_dir).select("bill_id", "policy_area"), "bill_id").groupBy("policy_area").agg(F.count("*").alias("mentions"), F.count_distinct("filing").alias("filings"), F.round(F.sum("amount"), 2).alias("amount"))


@query(f"SELECT bill_id, c_name AS sponsor, o_orderdate::DATE AS introduced FROM (SELECT DISTINCT bill_id, l_orderkey FROM {_LOG}) JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey")
def looked_up_bills(spark, sf_dir):
    """The bills that mentions name, once each, with their sponsors."""
    keys = table(spark, sf_dir, "lineitem").select(bill_id(F.col("l_orderkey")).alias("bill_id")).distinct()
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sponsor_id"), F.col("c_name").alias("sponsor"))
    return bills(spark, sf_dir).withColumnRenamed("sponsor", "sponsor_id").join(keys, "bill_id", "left_semi").join(people, "sponsor_id", "left").select("bill_id", "sponsor", "introduced")


@query(f"SELECT {_BILL.format('o_orderkey')} AS bill_id, array_to_string([{_BILL.format('o_orderkey')}, {_BILL.format('(o_custkey % 40)')}, '119:hr:6'][1:1 + o_orderkey % 3], ' ') AS refs FROM orders WHERE list_contains([{_BILL.format('o_orderkey')}, {_BILL.format('(o_custkey % 40)')}, '119:hr:6'][1:1 + o_orderkey % 3], '119:s:7')")
def filings_on_bill(spark, sf_dir):
    """Filings whose references contain a bill, as a whole entry: s:7 isn't in s:77."""
    k = F.col("o_orderkey")
    refs = F.slice(F.array(bill_id(k), bill_id(F.col("o_custkey") % 40), F.lit("119:hr:6")), F.lit(1), (1 + k % 3).cast("int"))
    return table(spark, sf_dir, "orders").select(bill_id(k).alias("bill_id"), refs.alias("refs")).filter(F.array_contains("refs", "119:s:7")).withColumn("refs", F.array_join("refs", " "))


@query("SELECT c_custkey, until AS served_until FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate)::DATE + 180 AS until FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE until IS NULL OR until >= DATE '1998-01-01'")
def active_members(spark, sf_dir):
    """Members whose time isn't over, or has no end: half a year after a member's last bill."""
    today = F.lit("1998-01-01").cast("date")
    ends = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.date_add(F.max(F.to_date("o_orderdate")), 180).alias("served_until"))
    people = table(spark, sf_dir, "customer").select("c_custkey").join(ends, "c_custkey", "left")
    return people.filter(F.col("served_until").isNull() | (F.col("served_until") >= today))


@query("SELECT o_orderkey, coalesce(latest, introduced) AS active_at FROM (SELECT o_orderkey, o_orderdate::DATE AS introduced, (SELECT max(l_shipdate)::DATE FROM lineitem WHERE l_orderkey = o_orderkey) AS latest FROM orders) WHERE coalesce(latest, introduced) >= DATE '1998-06-01' - 120")
def recently_active_bills(spark, sf_dir):
    latest = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.max("l_shipdate")).alias("latest"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("introduced")).join(latest, "o_orderkey", "left")
    return rows.select("o_orderkey", F.coalesce("latest", "introduced").alias("active_at")).filter(F.col("active_at") >= F.date_sub(F.lit("1998-06-01").cast("date"), 120))


TABS = {"votes": ("purchase", "click"), "texts": ("view",), "all": ("purchase", "click", "view", "signup", "error")}


@query("SELECT tab, event_id, event_type, n FROM (SELECT tab, event_id, event_type, row_number() OVER (PARTITION BY tab ORDER BY ts DESC, event_id DESC)::INT AS n FROM events JOIN (VALUES ('votes', 'purchase'), ('votes', 'click'), ('texts', 'view'), ('all', 'purchase'), ('all', 'click'), ('all', 'view'), ('all', 'signup'), ('all', 'error')) t(tab, kind) ON kind = event_type) WHERE n <= 30")
def feed_by_tab(spark, sf_dir):
    """The thirty newest events of each tab."""
    kinds = spark.createDataFrame([(t, k) for t, ks in TABS.items() for k in ks], "tab string, event_type string")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "ts").join(F.broadcast(kinds), "event_type")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("tab").orderBy(F.desc("ts"), F.desc("event_id")))).filter("n <= 30").select("tab", "event_id", "event_type", "n")


@query("SELECT event_type, user_id, n, (row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id))::INT AS place FROM (SELECT event_type, user_id, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-30' - INTERVAL 10 DAY AND ts <= TIMESTAMP '2024-01-30' GROUP BY ALL) QUALIFY place <= 10")
def leaders_by_type(spark, sf_dir):
    now = F.lit("2024-01-30").cast("timestamp_ntz")
    per = table(spark, sf_dir, "events").filter((F.col("ts") > now - F.expr("INTERVAL 10 DAYS")) & (F.col("ts") <= now)).groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return per.withColumn("place", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "user_id"))).filter("place <= 10")


@query(f"""WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 25)
SELECT o_custkey AS member, n, coalesce(o.title, CASE WHEN lower({_sql(TITLES, "o_custkey")}) LIKE 'chair%' THEN 'chair' WHEN trim(lower({_sql(TITLES, "o_custkey")})) IN ('ranking member', 'ranking minority member', 'ranking') THEN 'ranking' END) AS role FROM t LEFT JOIN (VALUES (1, 'Speaker'), (4, 'Whip')) o(m, title) ON o.m = o_custkey""")
def leaders_with_roles(spark, sf_dir):
    """The most active members with their roles: those set by hand come before those that titles tell."""
    top = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("member")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "member").limit(25)
    by_hand = F.when(F.col("member") == 1, "Speaker").when(F.col("member") == 4, "Whip")
    return top.withColumn("role", F.coalesce(by_hand, tables.leading_class(picked(TITLES, F.col("member")))))


@query("SELECT l_suppkey AS source, count(*) AS refs, count(o_orderkey) AS resolved, round(100.0 * count(o_orderkey) / count(*), 6)::DOUBLE AS pct FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey + l_partkey % 3 * 40 GROUP BY 1")
def backfill_report(spark, sf_dir):
    """Of each source's references how many name a bill that there is."""
    known = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bill"), F.lit(True).alias("known"))
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_orderkey") + F.col("l_partkey") % 3 * 40).alias("bill")).join(known, "bill", "left")
    resolved = F.count("known")
    return refs.groupBy("source").agg(F.count("*").alias("refs"), resolved.alias("resolved"), F.round(F.lit(100.0) * resolved / F.count("*"), 6).alias("pct"))


@query("""WITH m AS (SELECT c_custkey AS id, 'S' || (c_custkey % 211) AS name, n_name AS state, (SELECT list('F' || s_suppkey ORDER BY s_suppkey) FROM supplier WHERE s_suppkey = c_custkey) AS own FROM customer JOIN nation ON n_nationkey = c_nationkey),
c AS (SELECT o_custkey AS id, any_value(CASE WHEN o_custkey % 2 = 0 THEN 'C' || o_custkey END) AS fec FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
n AS (SELECT lower('s' || (s_suppkey % 211)) AS name, n_name AS state, max('N' || s_suppkey) AS found FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL HAVING count(DISTINCT s_suppkey) = 1)
SELECT CASE WHEN c.id IS NOT NULL THEN 'cached' WHEN own IS NOT NULL THEN 'primary' WHEN found IS NOT NULL THEN 'name' ELSE 'none' END AS via, count(*) AS n, count(CASE WHEN c.id IS NOT NULL THEN fec ELSE coalesce(own[1], found) END) AS with_id
FROM m LEFT JOIN c ON c.id = m.id LEFT JOIN n ON n.name = lower(m.name) AND n.state = m.state GROUP BY 1""")
def resolution_sources(spark, sf_dir):
    """Of each member the first source that knows it, the cache (also that there is none), its own ids, the only candidate of its name and state; how many each has resolved."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("state"))
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.array(F.concat(F.lit("F"), "s_suppkey")).alias("fec_ids"))
    people = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(own, "c_custkey", "left")
    people = people.select(F.col("c_custkey").alias("bioguide_id"), F.lit(1998).alias("cycle"), "fec_ids", F.concat(F.lit("S"), F.col("c_custkey") % 211).alias("name"), "state")
    k = F.col("o_custkey")
    cached = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(k.alias("bioguide_id")).distinct().select("bioguide_id", F.lit(1998).alias("cycle"), F.when(F.col("bioguide_id") % 2 == 0, F.concat(F.lit("C"), "bioguide_id")).alias("fec_id"))
    named = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), F.col("s_suppkey") % 211).alias("name"), "state", F.concat(F.lit("N"), "s_suppkey").alias("fec_id"))
    return readers.resolved_candidates(people, cached, named).groupBy(F.col("source").alias("via")).agg(F.count("*").alias("n"), F.count("fec_id").alias("with_id"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate) <= 50")
def filings_per_client(spark, sf_dir):
    """At most fifty filings of each client, which are a sample in a stated order."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate").withColumn("n", F.row_number().over(order)).filter("n <= 50").drop("n", "l_shipdate")


@query("SELECT ym, min(w)::INT AS label_column FROM (SELECT d, strftime(d, '%Y-%m') AS ym, datediff('day', DATE '2023-12-31', d) // 7 AS w FROM (SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY))::DATE AS d FROM events)) WHERE day(DATE '2023-12-31' + (w * 7 + 6)::INT) <= 7 AND strftime(DATE '2023-12-31' + (w * 7 + 6)::INT, '%Y-%m') = ym GROUP BY 1")
def month_labels(spark, sf_dir):
    """The column of a grid that carries a month's name: the first whose week ends within its first seven days."""
    days = table(spark, sf_dir, "events").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b")).select(F.explode(F.sequence("a", "b")).alias("d"))
    first = F.lit("2023-12-31").cast("date")
    w = F.floor(F.datediff("d", first) / 7).cast("int")
    end = F.date_add(first, w * 7 + 6)
    cells = days.select(w.alias("w"), F.date_format("d", "yyyy-MM").alias("ym"), end.alias("end")).filter((F.dayofmonth("end") <= 7) & (F.date_format("end", "yyyy-MM") == F.col("ym")))
    return cells.groupBy("ym").agg(F.min("w").alias("label_column"))


@query("SELECT date_trunc('week', ts + INTERVAL 1 DAY)::DATE - 1 AS week, count(DISTINCT ts::DATE)::BIGINT AS days, count(*) AS n, bool_or(dayofweek(ts) IN (0, 6)) AS weekend FROM events GROUP BY 1")
def weeks(spark, sf_dir):
    """Days and events by the week that begins on Sunday."""
    day = F.to_date("ts")
    return table(spark, sf_dir, "events").groupBy(F.date_sub(day, F.dayofweek(day) - 1).alias("week")).agg(F.count_distinct(day).alias("days"), F.count("*").alias("n"), F.bool_or(F.dayofweek(day).isin(1, 7)).alias("weekend"))


#: The versions that a summary may begin from, the first that there is.
EARLY = ("ih", "is", "rh", "rs", "eh", "es", "pcs", "pch")
VERSIONS = (*EARLY, "enr", "enr", "enr", "zz", "eh1s")


@query(f"""WITH v AS (SELECT l_orderkey, {_sql(VERSIONS, "l_partkey")} AS code, max(l_extendedprice * 20)::BIGINT AS chars FROM lineitem GROUP BY ALL),
p AS (SELECT l_orderkey, min(struct_pack(r := list_position(['ih', 'is', 'rh', 'rs', 'eh', 'es', 'pcs', 'pch'], code), code := code, chars := chars)) FILTER (list_position(['ih', 'is', 'rh', 'rs', 'eh', 'es', 'pcs', 'pch'], code) > 0) AS e, max(chars) FILTER (code = 'enr') AS enr FROM v GROUP BY 1),
t AS (SELECT l_orderkey, e.code AS code, (e.chars + enr) // 4 AS tokens FROM p WHERE e IS NOT NULL AND enr IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'P'))
SELECT l_orderkey, code, CASE code WHEN 'ih' THEN 'Introduced (House)' WHEN 'is' THEN 'Introduced (Senate)' WHEN 'rh' THEN 'Reported (House)' WHEN 'rs' THEN 'Reported (Senate)' WHEN 'eh' THEN 'Engrossed (House)' WHEN 'es' THEN 'Engrossed (Senate)' WHEN 'pcs' THEN 'Placed on Calendar (Senate)' ELSE 'Placed on Calendar (House)' END AS label, tokens,
CASE WHEN tokens <= 180000 THEN 'small-single' WHEN tokens <= 900000 THEN 'large-single' WHEN tokens <= 1800000 THEN 'chunked' ELSE 'punt' END AS tier,
round(CASE WHEN tokens <= 180000 THEN (tokens + 500) * 1 + 1500 * 5 WHEN tokens <= 900000 THEN (tokens + 500) * 3 + 1500 * 15 WHEN tokens <= 1800000 THEN (tokens + ceil(tokens / 700000) * 500) * 3 + (ceil(tokens / 700000) * 600 + 1500) * 15 ELSE 0 END / 1e6, 9)::DOUBLE AS cost FROM t""")
def earliest_versions(spark, sf_dir):
    """The summaries still to be made: of each enrolled bill without one the earliest version that there is, how large both are, how they would be summarised and at what cost."""
    code = picked(VERSIONS, F.col("l_partkey"))
    versions = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", code.alias("code")).agg(F.max(F.col("l_extendedprice") * 20).cast("decimal(18,0)").cast("long").alias("chars"))
    rank = F.array_position(F.array(*map(F.lit, EARLY)), F.col("code"))
    per = versions.groupBy("l_orderkey").agg(F.min(F.when(rank > 0, F.struct(rank.alias("r"), "code", "chars"))).alias("e"), F.max(F.when(F.col("code") == "enr", F.col("chars"))).alias("enr"))
    made = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    todo = per.filter("e IS NOT NULL AND enr IS NOT NULL").join(made, "l_orderkey", "left_anti")
    tokens = F.floor((F.col("e.chars") + F.col("enr")) / 4).cast("long")
    todo = todo.select("l_orderkey", "e.code", tokens.alias("tokens"))
    return todo.select("l_orderkey", "code", tables.version_label(F.col("code"), F.col("code")).alias("label"), "tokens", civic.summary_tier(F.col("tokens")).alias("tier"), F.round(civic.summary_cost(F.col("tokens")), 9).alias("cost"))


#: All codes in the order of a bill's way, one that has a label but no place, and one that has neither.
STAGES = ("ih", "is", "rh", "rs", "rfh", "rfs", "cph", "cps", "eh", "es", "eah", "eas", "rds", "rdh", "pcs", "ats", "ath", "enr", "pl", "pp", "es2", "lth", "zz")


@query(f"""WITH v AS (SELECT DISTINCT l_suppkey, code, CASE WHEN r <= 21 THEN r - 1 ELSE 999 END AS r FROM (SELECT l_suppkey, {_sql(STAGES, "l_partkey")} AS code, l_partkey % 23 + 1 AS r FROM lineitem) WHERE true)
SELECT l_suppkey, code, r::INT AS rank, (row_number() OVER (PARTITION BY l_suppkey ORDER BY r, code))::INT AS place, CASE code WHEN 'rfh' THEN 'Referred (House)' WHEN 'pcs' THEN 'Placed on Calendar (Senate)' WHEN 'pl' THEN 'Public Law' WHEN 'lth' THEN 'Laid on Table (House)' WHEN 'enr' THEN 'Enrolled' WHEN 'zz' THEN 'ZZ' END AS label FROM v WHERE code IN ('rfh', 'pcs', 'pl', 'lth', 'enr', 'zz', 'ih', 'es2')""")
def stages_in_order(spark, sf_dir):
    """Versions in the order of a bill's way: codes without a place are last, by name."""
    code = picked(STAGES, F.col("l_partkey"))
    seen = table(spark, sf_dir, "lineitem").select("l_suppkey", code.alias("code")).filter(F.col("code").isin("rfh", "pcs", "pl", "lth", "enr", "zz", "ih", "es2")).distinct().withColumn("rank", tables.stage_rank(F.col("code")))
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("rank", "code"))
    label = F.when(F.col("code").isin("ih", "es2"), None).otherwise(tables.version_label(F.col("code"), F.col("code")))
    return seen.select("l_suppkey", "code", "rank", place.alias("place"), label.alias("label"))


@query("SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY d DESC NULLS LAST, l_partkey, l_linenumber) AS newest_first FROM (SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_linenumber % 4 <> 0 THEN l_shipdate END AS d FROM lineitem) GROUP BY 1")
def versions_newest_first(spark, sf_dir):
    """A bill's versions, the newest first and those without a date last; a bill has some dozen versions at the most, so its row is small."""
    dated = F.when(F.col("l_linenumber") % 4 != 0, F.unix_seconds(F.col("l_shipdate").cast("timestamp")))
    each = F.struct(dated.isNull().alias("none"), (-dated).alias("at"), "l_partkey", "l_linenumber")
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(each)).alias("v"))
    return per.select("l_orderkey", F.array_join(F.transform("v.l_partkey", lambda x: x.cast("string")), ",").alias("newest_first"))


SORTS = {"newest": (F.desc_nulls_last, "o_orderdate"), "oldest": (F.asc_nulls_last, "o_orderdate"), "largest": (F.desc_nulls_last, "o_totalprice"), "number": (F.asc, "o_orderkey")}


def sorted_page(rows: DataFrame, mode: str, page: int, size: int) -> DataFrame:
    """A page, counted from 1, of rows in one of the orders, and how many pages there are; an unknown order is the newest first."""
    way, column = SORTS.get(mode, SORTS["newest"])
    pages = rows.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("long").alias("pages"))
    return rows.orderBy(way(column), "o_orderkey").offset((page - 1) * size).limit(size).join(F.broadcast(pages))


_PAGE = "SELECT '{0}' AS mode, o_orderkey, (SELECT greatest(1, ceil(count(*) / 50.0))::BIGINT FROM orders WHERE o_orderstatus = 'O') AS pages FROM (SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY {1}, o_orderkey LIMIT 50 OFFSET 50)"


@query(" UNION ALL ".join(_PAGE.format(m, o) for m, o in (("newest", "o_orderdate DESC NULLS LAST"), ("oldest", "o_orderdate"), ("largest", "o_totalprice DESC"), ("number", "o_orderkey"))))
def sort_modes(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", "o_orderdate", "o_totalprice")
    pages = [sorted_page(rows, mode, 2, 50).select(F.lit(mode).alias("mode"), "o_orderkey", "pages") for mode in SORTS]
    out = pages[0]
    for p in pages[1:]:
        out = out.union(p)
    return out


@query("SELECT ts::DATE AS day, count(*) AS total, array_to_string(list(event_id || ':' || coalesce(c_name, '?') ORDER BY ts, event_id)[1:5], ',') AS shown, count(*) > 5 AS truncated FROM events LEFT JOIN customer ON c_custkey = user_id GROUP BY 1")
def day_items(spark, sf_dir):
    """The first five events of each day with their members' names where known, how many there are, and whether some aren't shown."""
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "ts", "event_id", "user_id")
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("day").orderBy("ts", "event_id"))).filter("n <= 5").join(names, "user_id", "left")
    item = F.struct("n", F.concat_ws(":", F.col("event_id").cast("string"), F.coalesce("c_name", F.lit("?"))).alias("item"))
    shown = first.groupBy("day").agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["item"]), ",").alias("shown"))  # five a day
    return rows.groupBy("day").agg(F.count("*").alias("total")).join(shown, "day").select("day", "total", "shown", (F.col("total") > 5).alias("truncated"))


_SLUG = "CASE split_part(b, ':', 2) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tables.SLUGS.items()) + " END"


@query(f"SELECT b AS bill_id, 'https://www.congress.gov/bill/119th-congress/' || {_SLUG} || '/' || split_part(b, ':', 3) AS url FROM (SELECT {_BILL.format('o_orderkey')} AS b FROM orders)")
def bill_urls(spark, sf_dir):
    return bills(spark, sf_dir).select("bill_id", tables.bill_url(F.col("bill_id")).alias("url"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN rtrim(substr(text, 1, 79), ' ') || '…' ELSE text END AS short FROM documents")
def shortened_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tables.shortened(F.col("text"), 80).alias("short"))


@query("SELECT url, CASE lower(regexp_extract(url, '\\.(\\w+)$', 1)) WHEN 'htm' THEN 'HTML' WHEN 'html' THEN 'HTML' WHEN 'xml' THEN 'XML' WHEN 'pdf' THEN 'PDF' WHEN 'txt' THEN 'Text' WHEN '' THEN NULL ELSE upper(regexp_extract(url, '\\.(\\w+)$', 1)) END AS format FROM (SELECT url || ['.htm', '', '.PDF', '.docx', '.xml'][page_id % 5 + 1] AS url FROM pages)")
def format_labels(spark, sf_dir):
    url = F.concat("url", picked((".htm", "", ".PDF", ".docx", ".xml"), F.col("page_id")))
    return table(spark, sf_dir, "pages").select(url.alias("url")).withColumn("format", tables.format_label(F.col("url")))


@query("""WITH d AS (SELECT DISTINCT user_id::VARCHAR AS source, ts::DATE AS day FROM events), c AS (SELECT source, min(day) AS cursor FROM d GROUP BY 1),
g AS (SELECT source, min(x.day) AS first_gap FROM c, (SELECT unnest(generate_series(DATE '2024-01-28', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS day) x WHERE x.day > c.cursor AND NOT EXISTS (SELECT 1 FROM d WHERE d.source = c.source AND d.day = x.day) GROUP BY 1)
SELECT source, cursor, first_gap, greatest(cursor, coalesce(first_gap - 1, DATE '2024-01-31')) AS advance_to FROM c LEFT JOIN g USING (source)""")
def safe_horizon(spark, sf_dir):
    """How far each source's cursor may go from its first day: not past a missing day that is younger than four days; older gaps are final."""
    landed = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("source"), F.to_date("ts").alias("day")).distinct()
    first = landed.groupBy("source").agg(F.min("day").alias("cursor"))
    return cursors.advanced(first, landed, F.lit("2024-01-31").cast("date"))


@query("SELECT o_custkey AS source, max(o_orderdate) AS seen, greatest(max(o_orderdate), TIMESTAMP '1997-06-01') AS cursor, greatest(max(o_orderdate), TIMESTAMP '1997-06-01') - INTERVAL 4 DAY AS read_from FROM orders GROUP BY 1")
def cursor_advance(spark, sf_dir):
    """Cursors go forward only, to the greatest date seen; the next run reads from four days before."""
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("source")).agg(F.max("o_orderdate").alias("seen"))
    cursor = F.greatest("seen", F.lit("1997-06-01").cast("timestamp_ntz"))
    return per.select("source", "seen", cursor.alias("cursor"), (cursor - F.expr("INTERVAL 4 DAYS")).alias("read_from"))


@query("SELECT d.doc_id, d.source, c.doc_id AS cached FROM documents d LEFT JOIN (SELECT md5(text) AS k, lang, min(doc_id) AS doc_id FROM documents WHERE source < 'src5' GROUP BY ALL) c ON c.k = md5(d.text) AND c.lang = d.lang")
def content_cache(spark, sf_dir):
    """A cache by content: a document meets what was made of the same text in the same language, or nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.md5("text").alias("k"))
    cache = docs.filter(F.col("source") < "src5").groupBy("k", "lang").agg(F.min("doc_id").alias("cached"))
    return docs.join(cache, ["k", "lang"], "left").select("doc_id", "source", "cached")


_STRIPPED = "regexp_replace(text || ' see H.R. 12 and S.J. Res. 4, Act', '(?i)\\b(h|s)\\.?\\s*((j|con)\\.?\\s*)?(r\\.?|res\\.?)?\\s*\\d{1,5}\\b', ' ', 'g')"


@query(f"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({_STRIPPED}, '[A-Za-z][A-Za-z''-]+'), lambda w: lower(w)), lambda w: length(w) > 2 AND w NOT IN ('act', 'and', 'see', 'the')))), ' ') AS words FROM conversations")
def mention_tokens(spark, sf_dir):
    """The words of a mention, without the bills that it names and without words that say nothing."""
    text = F.concat("text", F.lit(" see H.R. 12 and S.J. Res. 4, Act"))
    words = civic.tokens(civic.without_references(text), ("act", "and", "see", "the"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(words), " ").alias("words"))


@query(f"WITH passed AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F'), texts AS (SELECT doc_id, n_chars FROM documents) SELECT {_BILL.format('k')} AS bill_id, n_chars, c_name AS sponsor FROM passed JOIN texts ON doc_id = k LEFT JOIN orders ON o_orderkey = k LEFT JOIN customer ON c_custkey = o_custkey")
def passed_texts(spark, sf_dir):
    """Passed bills that have a text, with their sponsors where known."""
    passed = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("o_orderkey"), "n_chars")
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("sponsor"))
    return passed.join(texts, "o_orderkey").join(people, "o_custkey", "left").select(bill_id(F.col("o_orderkey")).alias("bill_id"), "n_chars", "sponsor")


def titled_bills(spark, sf_dir) -> DataFrame:
    known = bills(spark, sf_dir)
    return known.withColumns({"title": F.concat_ws(" ", "policy_area", F.lit("Act of"), F.year("introduced").cast("string"), F.lit("No."), F.col("number").cast("string")), "active_at": F.col("introduced")})


_TITLED = f"(SELECT {_BILL.format('o_orderkey')} AS bill_id, {_sql(('hr', 's', 'hconres'), 'o_orderkey')} AS bill_type, o_orderkey AS number, {_sql(AREAS, 'o_orderkey')} AS policy_area, {_sql(AREAS, 'o_orderkey')} || ' Act of ' || year(o_orderdate) || ' No. ' || o_orderkey AS title, o_orderdate::DATE AS active_at FROM orders)"


@query(f"SELECT 'title' AS facet, count(*) AS n, max(bill_id) AS last FROM {_TITLED} WHERE contains(lower(title), 'health act') UNION ALL SELECT 'kind', count(*), max(bill_id) FROM {_TITLED} WHERE bill_type IN ('hconres', 'sconres') UNION ALL SELECT 'house and area', count(*), max(bill_id) FROM {_TITLED} WHERE bill_type LIKE 'h%' AND policy_area = 'Energy' UNION ALL SELECT 'all', count(*), max(bill_id) FROM {_TITLED} WHERE contains(lower(title), '199') AND bill_type = 's' AND policy_area = 'Taxation'")
def bills_faceted(spark, sf_dir):
    """Bills under each facet, and under several at once."""
    asked = {"title": {"text": "Health Act"}, "kind": {"kind": "concurrent"}, "house and area": {"chamber": "house", "policy_area": "Energy"}, "all": {"text": "199", "bill_type": "S", "kind": "bills", "chamber": "senate", "policy_area": "Taxation"}}
    parts = [search.with_facets(titled_bills(spark, sf_dir), **facets).agg(F.count("*").alias("n"), F.max("bill_id").alias("last")).select(F.lit(name).alias("facet"), "n", "last") for name, facets in asked.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_HITS = "SELECT '{0}' AS q, 'bill' AS kind, bill_id AS id, rank::INT AS rank FROM (SELECT *, CASE WHEN {1} THEN 0 WHEN {2} THEN 1 ELSE 2 END AS rank FROM {3} WHERE {1} OR {2} OR contains(lower(title), '{0}') ORDER BY rank, active_at DESC, bill_id LIMIT 10)"
_PEOPLE = "SELECT '{0}' AS q, 'member' AS kind, c_custkey::VARCHAR AS id, NULL::INT AS rank FROM (SELECT * FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE contains(lower(c_name), '{0}') OR lower(n_name) = '{0}' ORDER BY c_mktsegment, c_name, c_custkey LIMIT 10)"


@query(" UNION ALL ".join([_HITS.format("12", "false", "number = 12", _TITLED), _HITS.format("hr 12", "bill_type = 'hr' AND number = 12", "false", _TITLED), _HITS.format("s.7", "bill_type = 's' AND number = 7", "false", _TITLED), _HITS.format("china", "false", "false", _TITLED), *[_PEOPLE.format(q) for q in ("12", "hr 12", "s.7", "china")]]))
def search_all(spark, sf_dir):
    """What a search finds on both sides, members and bills, for some texts; one character finds nothing."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("state"))
    people = table(spark, sf_dir, "customer").join(nation, "c_nationkey").select(F.col("c_custkey").alias("member"), F.col("c_name").alias("full_name"), F.col("c_name").alias("last_name"), "state", F.col("c_mktsegment").alias("chamber"))
    known, out = titled_bills(spark, sf_dir), None
    for q in ("12", "HR 12", "s.7", " China ", "x"):
        name = F.lit(q.strip().lower()).alias("q")
        hits = search.found_bills(known, q, 10).select(name, F.lit("bill").alias("kind"), F.col("bill_id").alias("id"), "rank")
        hits = hits.unionByName(search.found_members(people, q, 10).select(name, F.lit("member").alias("kind"), F.col("member").cast("string").alias("id"), F.lit(None).cast("int").alias("rank")))
        out = hits if out is None else out.unionByName(hits)
    return out


@query("""WITH c AS (SELECT p_partkey AS code, p_name AS name, p_brand AS chamber, CASE WHEN p_partkey % 10 = 0 THEN 'standing' WHEN p_partkey % 10 = 5 THEN 'joint' ELSE 'subcommittee' END AS type, CASE WHEN p_partkey % 7 = 0 THEN -1 ELSE p_partkey - p_partkey % 10 END AS parent FROM part),
n AS (SELECT code, name, chamber, false AS is_sub, code AS parent, name AS pn, type AS pt, chamber AS pc FROM c WHERE type <> 'subcommittee' UNION ALL SELECT s.code, s.name, s.chamber, true, p.code, p.name, p.type, p.chamber FROM c s JOIN c p ON p.code = s.parent AND p.type <> 'subcommittee' WHERE s.type = 'subcommittee')
SELECT code, name, is_sub, parent, (row_number() OVER (PARTITION BY pc ORDER BY pt DESC, pn, parent, is_sub, name, code))::INT AS place FROM n""")
def committee_options(spark, sf_dir):
    """Committees with their subcommittees below them, by their place in their chamber's list; a subcommittee without its parent isn't in it."""
    k = F.col("p_partkey")
    kind = F.when(k % 10 == 0, "standing").when(k % 10 == 5, "joint").otherwise("subcommittee")
    known = table(spark, sf_dir, "part").select(k.alias("committee_code"), F.col("p_name").alias("name"), F.col("p_brand").alias("chamber"), kind.alias("committee_type"), F.when(k % 7 == 0, -1).otherwise(k - k % 10).alias("parent_code"))
    place = F.row_number().over(Window.partitionBy("parent_chamber").orderBy(*search.committee_order()))
    return search.nested_committees(known).select(F.col("committee_code").alias("code"), "name", "is_sub", F.col("parent_code").alias("parent"), place.alias("place"))
