"""Landed raw files to event and table rows. Fetching stays outside: each reader takes the folder that the fetcher has written.

Every reader states its schema, so no file is read to guess it, and yields events as (source, source_id, entity_id,
event_type, occurred_at, payload, payload_hash) or a table's columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import civic, tables
from ..operators.eventlog import latest_per_key
from . import texttree


def as_events(df: DataFrame, source: str, source_id: Column, entity_id: Column, event_type: Column | str, occurred_at: Column, payload: list[Column] | Column) -> DataFrame:
    kind = F.lit(event_type) if isinstance(event_type, str) else event_type
    body = F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}) if isinstance(payload, list) else payload
    out = df.select(F.lit(source).alias("source"), source_id.alias("source_id"), entity_id.alias("entity_id"), kind.alias("event_type"), occurred_at.alias("occurred_at"), body.alias("payload"))
    return out.withColumn("payload_hash", F.substring(F.sha2("payload", 256), 1, 16))


def with_party_line(votes: DataFrame, call: list[str]) -> DataFrame:
    """votes (party, position, ord, ...) and party_line: whether a Yea or Nay was its party's more frequent one; of equally frequent ones the first counts."""
    of = Window.partitionBy(*call, "party")
    said = F.col("position")
    count, first = (lambda p: F.count_if(said == p).over(of)), (lambda p: F.min(F.when(said == p, F.col("ord"))).over(of))
    both = votes.withColumns({"__yea": F.struct(count("Yea").alias("c"), (-first("Yea")).alias("first")), "__nay": F.struct(count("Nay").alias("c"), (-first("Nay")).alias("first"))})
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in (*call, "party")])
    majority = F.when(F.col("__yea") > F.col("__nay"), "Yea").otherwise("Nay")
    return both.withColumn("party_line", F.when(said.isin("Yea", "Nay") & known, said == majority)).drop("__yea", "__nay")


HOUSE_VOTE = """`vote-metadata` struct<congress:string,session:string,`rollcall-num`:int,`legis-num`:string,`vote-question`:string,`vote-type`:string,`vote-result`:string,`action-date`:string,`action-time`:struct<_VALUE:string,`_time-etz`:string>>,
`vote-data` struct<`recorded-vote`:array<struct<legislator:struct<_VALUE:string,`_name-id`:string,`_party`:string,`_state`:string>,vote:string>>>"""


def house_votes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A row per member of House roll-call documents, as events vote.cast and vote.missed."""
    raw = spark.read.format("xml").option("rowTag", "rollcall-vote").schema(HOUSE_VOTE).load(path)
    m = "`vote-metadata`."
    calls = raw.select(F.col(m + "congress").alias("congress"), F.col(m + "session").alias("session"), F.col(m + "`rollcall-num`").alias("rollcall_num"), F.col(m + "`legis-num`").alias("legis_num"),
                      F.col(m + "`vote-question`").alias("question"), F.col(m + "`vote-type`").alias("vote_type"), F.col(m + "`vote-result`").alias("result"),
                      civic.eastern_time(F.col(m + "`action-date`"), F.col(m + "`action-time`._time-etz".replace("_time-etz", "`_time-etz`"))).alias("at"), F.col("`vote-data`.`recorded-vote`").alias("all"))  # moments are made once a call
    each = calls.select("*", F.posexplode("all").alias("ord", "v")).drop("all")
    each = each.select("*", F.col("v.legislator.`_name-id`").alias("member"), F.col("v.legislator._party").alias("party"), F.col("v.legislator._state").alias("state"), civic.vote(F.col("v.vote")).alias("position")).drop("v")
    return _votes(with_party_line(each, ["congress", "session", "rollcall_num"]), "congress_rollcalls", "house")


SENATE_VOTE = """congress string, session string, vote_number int, vote_question_text string, vote_result string, vote_date string, document struct<document_type:string,document_number:string>,
members struct<member:array<struct<lis_member_id:string,last_name:string,state:string,party:string,vote_cast:string>>>"""


def senate_votes(spark: SparkSession, path: str | list[str], lis_index: DataFrame) -> DataFrame:
    """A row per senator; members are found by LIS id in lis_index (lis, bioguide, last_name, state), else by name and state; unknown ones are dropped."""
    raw = spark.read.format("xml").option("rowTag", "roll_call_vote").option("mode", "PERMISSIVE").schema(SENATE_VOTE).load(path).filter(F.col("members").isNotNull())
    calls = raw.select("congress", "session", F.col("vote_number").alias("rollcall_num"), F.trim(F.concat_ws(" ", "document.document_type", "document.document_number")).alias("legis_num"), F.col("vote_question_text").alias("question"),
                      F.lit(None).cast("string").alias("vote_type"), F.col("vote_result").alias("result"), civic.vote_date(F.col("vote_date")).alias("at"), F.col("members.member").alias("all"))
    each = calls.select("*", F.posexplode("all").alias("ord", "v")).drop("all")
    each = each.select("*", "v.lis_member_id", "v.party", "v.state", F.lower("v.last_name").alias("__name"), civic.vote(F.col("v.vote_cast")).alias("position")).drop("v")
    by_id = lis_index.select(F.col("lis").alias("lis_member_id"), F.col("bioguide").alias("__by_id")).dropDuplicates(["lis_member_id"])
    by_name = lis_index.groupBy(F.lower("last_name").alias("__name"), "state").agg(F.max("bioguide").alias("__by_name"))
    found = each.join(by_id, "lis_member_id", "left").join(by_name, ["__name", "state"], "left")
    found = found.withColumn("member", F.coalesce("__by_id", "__by_name")).drop("__by_id", "__by_name", "__name", "lis_member_id").filter(F.col("member").isNotNull())
    return _votes(with_party_line(found, ["congress", "session", "rollcall_num"]), "senate_rollcalls", "senate")


def _votes(each: DataFrame, source: str, chamber: str) -> DataFrame:
    said = F.col("position").isin("Yea", "Nay", "Present")
    fields = [F.lit(chamber).alias("chamber"), *[F.col(c) for c in ("rollcall_num", "congress", "session", "legis_num", "question", "vote_type", "result", "position", "party", "state", "party_line")]]
    key = F.concat_ws(":", F.lit(chamber), "congress", "session", F.col("rollcall_num").cast("string"), "member")
    kind = F.when(said, "vote.cast").otherwise("vote.missed")
    return as_events(each, source, key, F.concat(F.lit("bioguide:"), "member"), kind, F.col("at"), fields)


BILL_STATUS = """congress int, type string, number int, title string, introducedDate string, updateDate string, latestAction struct<text:string,actionDate:string>, policyArea struct<name:string>,
sponsors struct<item:array<struct<bioguideId:string>>>, cosponsors struct<item:array<struct<bioguideId:string,sponsorshipDate:string,isOriginalCosponsor:string>>>,
textVersions struct<item:array<struct<type:string,date:string,formats:struct<item:array<struct<url:string>>>>>>,
actions struct<item:array<struct<actionDate:string,actionCode:string,type:string,text:string,committees:struct<item:array<struct<name:string>>>>>>"""


def bill_status(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(bills, events): a table row per bill; events for its sponsor, its cosponsors and its actions."""
    raw = spark.read.format("xml").option("rowTag", "bill").schema(BILL_STATUS).load(path)
    raw = raw.withColumn("bill_type", F.lower("type")).withColumn("bill_id", F.concat_ws(":", F.col("congress").cast("string"), "bill_type", F.col("number").cast("string")))
    day = lambda c: F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")
    sponsor = F.try_element_at("sponsors.item", F.lit(1))["bioguideId"]
    bills = raw.select("bill_id", "congress", "bill_type", "number", "title", sponsor.alias("sponsor_bioguide"), day(F.col("introducedDate")).alias("introduced_date"), day(F.col("latestAction.actionDate")).alias("latest_action_date"),
                       F.col("latestAction.text").alias("latest_action_text"), F.col("policyArea.name").alias("policy_area"), F.coalesce(F.size("cosponsors.item"), F.lit(0)).alias("cosponsor_count"), F.to_json("textVersions.item").alias("text_versions"))
    base = [F.col(c) for c in ("bill_id", "congress", "bill_type", "number")]
    member = lambda c: F.concat(F.lit("bioguide:"), c)
    kinds = "kind string, c struct<bioguideId:string,sponsorshipDate:string,isOriginalCosponsor:string>, a struct<actionDate:string,actionCode:string,type:string,text:string,committees:struct<item:array<struct<name:string>>>>"
    none = lambda name: F.lit(None).alias(name)
    facts = F.concat(*[F.coalesce(x.cast(f"array<struct<{kinds.replace(' string', ':string').replace(' struct', ':struct')}>>"), F.array()) for x in (
        F.when(sponsor.isNotNull(), F.array(F.struct(F.lit("sponsor").alias("kind"), none("c"), none("a")))),
        F.transform("cosponsors.item", lambda c: F.struct(F.lit("cosponsor").alias("kind"), c.alias("c"), none("a"))),
        F.transform("actions.item", lambda a: F.struct(F.lit("action").alias("kind"), none("c"), a.alias("a"))),
    )])
    # a bill's facts are told one by one, so its document is read once and not once for each kind
    each = raw.select("bill_id", "congress", "bill_type", "number", "title", "introducedDate", sponsor.alias("sponsor"), facts.alias("facts")).select("*", F.explode("facts").alias("f")).select("*", "f.kind", "f.c", "f.a").drop("facts", "f")
    one = lambda s, c, a: F.when(F.col("kind") == "sponsor", s).when(F.col("kind") == "cosponsor", c).otherwise(a)
    said = lambda *fields: F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    key = one(F.concat_ws(":", F.lit("sponsor"), "bill_id"), F.concat_ws(":", F.lit("cosponsor"), "bill_id", "c.bioguideId"), F.concat_ws(":", F.lit("action"), "bill_id", "a.actionDate", "a.actionCode", F.substring(F.sha2(F.coalesce("a.text", F.lit("")), 256), 1, 12)))
    body = one(said(*base, F.col("title"), F.col("introducedDate").alias("introduced_date")), said(*base, F.col("title"), (F.col("c.isOriginalCosponsor") == "True").alias("is_original")),
               said(*base, F.col("a.actionDate").alias("action_date"), F.col("a.actionCode").alias("action_code"), F.col("a.type").alias("action_type"), F.col("a.text").alias("text"), F.col("a.committees.item.name").alias("committees")))
    events = as_events(each, "govinfo_billstatus", key, one(member(F.col("sponsor")), member(F.col("c.bioguideId")), F.concat(F.lit("bill:"), "bill_id")), one(F.lit("bill.sponsored"), F.lit("bill.cosponsored"), F.lit("bill.action")), civic.iso_time(one(F.col("introducedDate"), F.col("c.sponsorshipDate"), F.col("a.actionDate"))), body)
    return bills, events


FILING = """filing_uuid string, filing_type string, filing_year int, filing_period string, dt_posted string, income string, expenses string, registrant struct<id:bigint,name:string>, client struct<id:bigint,name:string>,
lobbying_activities array<struct<general_issue_code:string,description:string>>, filing_document_url string"""


def lobbying_filings(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(filings, events): a table row per filing of landed pages {"results": [...]}; an event per bill that its descriptions name, with an equal share of the amount."""
    pages = spark.read.schema(f"results array<struct<{FILING.replace(' string', ':string').replace(' int', ':int').replace(' struct', ':struct').replace(' array', ':array')}>>").option("multiLine", True).json(path)
    f = pages.select(F.explode("results").alias("f")).select("f.*")
    refs = F.array_distinct(F.flatten(F.transform("lobbying_activities", lambda a: civic.bill_references(a["description"], F.col("filing_year")))))
    f = f.withColumns({"bill_refs": F.array_sort(F.coalesce(refs, F.array().cast("array<string>"))), "issue_codes": F.array_sort(F.array_distinct(F.coalesce(F.col("lobbying_activities.general_issue_code"), F.array().cast("array<string>"))))})
    f = f.withColumns({"income": F.col("income").try_cast("decimal(18,3)"), "expenses": F.col("expenses").try_cast("decimal(18,3)")})
    filings = f.select("filing_uuid", "filing_year", "filing_period", civic.iso_time(F.col("dt_posted")).alias("dt_posted"), "income", "expenses", F.col("registrant.id").cast("string").alias("registrant_id"), F.col("registrant.name").alias("registrant_name"),
                       F.col("client.id").cast("string").alias("client_id"), F.col("client.name").alias("client_name"), F.size("lobbying_activities").alias("activity_count"), "issue_codes", "bill_refs", F.col("filing_document_url").alias("raw_url"))
    share = F.coalesce(F.col("income"), F.col("expenses"), F.lit(0)).cast("double") / F.size("bill_refs")
    each = filings.withColumn("amount_share", F.when(F.size("bill_refs") > 0, share)).select("*", F.explode("bill_refs").alias("bill_id"))
    events = as_events(each, "lda_senate", F.concat_ws(":", "filing_uuid", "bill_id"), F.concat(F.lit("bill:"), "bill_id"), "bill_lobbied", F.col("dt_posted"),
                       [F.col(c) for c in ("bill_id", "filing_uuid", "registrant_id", "registrant_name", "client_id", "client_name", "filing_year", "filing_period", "issue_codes", "amount_share", "raw_url")])
    return filings, events


MODS = """titleInfo struct<title:string>, identifier array<struct<_VALUE:string,_type:string>>, part array<struct<extent:struct<start:string,end:string>>>, _type string,
extension array<struct<granuleClass:string,accessId:string,congMember:array<struct<_bioGuideId:string,_congress:string,_role:string,_party:string,_state:string>>,isReferringTo:array<struct<_VALUE:string,_type:string,_ID:string,_href:string>>>>"""


def floor_speeches(spark: SparkSession, path: str | list[str], day: str | None = None) -> DataFrame:
    """An event per member named by a granule of the Record, with the bills that it refers to; digests and granules without members or a name are none.

    The day is given, or told by the folder day=yyyy-MM-dd that a file lies in; it counts as noon.
    """
    raw = spark.read.format("xml").option("rowTag", "relatedItem").option("ignoreNamespace", True).schema(MODS).load(path)
    on = F.regexp_extract("_metadata.file_path", r"day=(\d{4}-\d{2}-\d{2})", 1) if day is None else F.lit(day)
    each_of = lambda f: F.flatten(F.filter(F.transform("extension", lambda e: e[f]), lambda m: m.isNotNull()))
    first = lambda f: F.trim(F.coalesce(F.try_element_at(F.filter(F.transform("extension", lambda e: e[f]), lambda x: x.isNotNull()), F.lit(1)), F.lit("")))
    extent = F.try_element_at(F.filter(F.transform("part", lambda p: p["extent"]), lambda x: x["start"].isNotNull() | x["end"].isNotNull()), F.lit(1))
    bills = F.filter(each_of("isReferringTo"), lambda r: r["_type"].isin("bill", "law", "publiclaw") | F.contains(F.lower(F.coalesce(r["_ID"], F.lit(""))), F.lit("bill")))
    refs = F.transform(bills, lambda r: F.struct(r["_type"].alias("type"), F.coalesce(F.nullif(r["_ID"], F.lit("")), r["_href"], F.substring(F.trim(F.coalesce(r["_VALUE"], F.lit(""))), 1, 80)).alias("ref")))
    g = raw.filter(F.coalesce("_type", F.lit("constituent")) == "constituent").select(
        on.alias("date"), F.trim("titleInfo.title").alias("title"), first("granuleClass").alias("granule_class"), first("accessId").alias("granule"), F.trim(extent["start"]).alias("page_start"), F.trim(extent["end"]).alias("page_end"),
        F.trim(F.try_element_at(F.filter("identifier", lambda i: i["_type"] == "preferred citation"), F.lit(1))["_VALUE"]).alias("citation"), each_of("congMember").alias("members"), F.when(F.size(refs) > 0, refs).alias("bill_refs"),
    )
    g = g.filter((F.size("members") > 0) & (F.upper("granule_class") != "DAILYDIGEST") & (F.col("granule") != "")).withColumn("speaker_count", F.size("members"))
    each = g.select("*", F.explode("members").alias("m")).withColumn("member", F.trim("m._bioGuideId")).filter("member <> ''")
    url = F.concat(F.lit("https://www.govinfo.gov/app/details/CREC-"), "date", F.lit("/"), "granule")
    fields = [F.lower("granule_class").alias("chamber"), F.col("m._congress").try_cast("int").alias("congress"), *[F.col(c) for c in ("title", "citation", "page_start", "page_end", "granule_class")], url.alias("granule_url"),
              *[F.coalesce(F.col(f"m._{c}"), F.lit("")).alias(c) for c in ("role", "party", "state")], F.col("speaker_count"), F.col("date"), F.col("bill_refs")]
    noon = F.to_timestamp(F.concat("date", F.lit(" 12:00:00")))
    return as_events(each, "govinfo_crec", F.concat_ws(":", "granule", "member"), F.concat(F.lit("bioguide:"), "member"), "floor.speech", noon, fields)


MEETING = "committeeMeeting struct<eventId:string,congress:int,chamber:string,date:string,type:string,title:string,committees:array<struct<systemCode:string,name:string>>,witnesses:array<struct<name:string,organization:string,position:string>>>"


def committee_meetings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """An event per meeting and one per witness, of its first committee or else its chamber."""
    m = spark.read.schema(MEETING).json(path).select("committeeMeeting.*")
    first = F.try_element_at("committees", F.lit(1))
    entity = F.coalesce(F.concat(F.lit("committee:"), first["systemCode"]), F.concat(F.lit("chamber:"), F.lower("chamber")))
    fields = [F.col("congress"), F.col("chamber"), F.col("eventId").alias("event_id"), F.col("type").alias("meeting_type"), F.col("title"), first["systemCode"].alias("committee_code"), first["name"].alias("committee_name")]
    held = as_events(m, "congress_committee_meetings", F.concat(F.lit("meeting:"), "eventId"), entity, "committee.meeting", civic.iso_time(F.col("date")), fields)
    w = m.select("*", F.posexplode("witnesses").alias("i", "w"))
    heard = as_events(w, "congress_committee_meetings", F.concat_ws(":", F.lit("witness"), "eventId", F.col("i").cast("string")), entity, "committee.witness", civic.iso_time(F.col("date")), [*fields, F.col("w.name").alias("witness_name"), F.col("w.organization").alias("witness_organization"), F.col("w.position").alias("witness_position")])
    return held.unionByName(heard)


AMENDMENT = "amendment struct<congress:int,type:string,number:int,sponsors:array<struct<bioguideId:string>>,submittedDate:string,updateDate:string,purpose:string,description:string,latestAction:struct<text:string>,amendedBill:struct<congress:int,type:string,number:string>>"


def amendments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    a = spark.read.schema(AMENDMENT).json(path).select("amendment.*").select("*", F.try_element_at("sponsors", F.lit(1))["bioguideId"].alias("member")).filter(F.col("member").isNotNull())
    key = F.concat_ws(":", F.col("congress").cast("string"), F.lower("type"), F.col("number").cast("string"))
    bill = F.when(F.col("amendedBill").isNotNull(), F.concat_ws(":", F.col("amendedBill.congress").cast("string"), F.lower("amendedBill.type"), "amendedBill.number"))
    fields = [key.alias("amendment_id"), F.col("congress"), F.lower("type").alias("amendment_type"), F.col("number"), F.coalesce("purpose", "description").alias("purpose"), F.col("latestAction.text").alias("latest_action"), bill.alias("bill_id")]
    return as_events(a, "congress_amendments", key, F.concat(F.lit("bioguide:"), "member"), "floor.amendment_offered", civic.iso_time(F.coalesce("submittedDate", "updateDate")), fields)


SUMMARIES = "summaries array<struct<bill:struct<congress:int,type:string,number:string>,versionCode:string,actionDate:string,actionDesc:string,text:string,updateDate:string>>"


def bill_summaries(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of the summaries table, the texts without markup."""
    from ..text.clean import text_lines

    s = spark.read.schema(SUMMARIES).option("multiLine", True).json(path).select(F.explode("summaries").alias("s")).select("s.*")
    return s.select(F.concat_ws(":", F.col("bill.congress").cast("string"), F.lower("bill.type"), "bill.number").alias("bill_id"), F.col("versionCode").alias("version_code"), F.try_to_date("actionDate", "yyyy-MM-dd").alias("action_date"),
                    F.col("actionDesc").alias("action_desc"), text_lines(F.col("text")).alias("summary_text"), civic.iso_time(F.col("updateDate")).alias("update_date"))


LEGISLATOR = "id struct<bioguide:string,govtrack:bigint,lis:string,fec:array<string>>, name struct<first:string,last:string,official_full:string>, terms array<struct<type:string,start:string,end:string,state:string,district:int,party:string>>"


def legislators(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Members by their last term; the YAML is landed as JSON lines."""
    p = spark.read.schema(LEGISLATOR).json(path)
    last = F.try_element_at("terms", F.lit(-1))
    return p.select(F.col("id.bioguide").alias("bioguide_id"), F.col("name.first").alias("first_name"), F.col("name.last").alias("last_name"), F.coalesce("name.official_full", F.concat_ws(" ", "name.first", "name.last")).alias("full_name"),
                    F.when(last["type"] == "sen", "senate").otherwise("house").alias("chamber"), last["state"].alias("state"), last["district"].alias("district"), last["party"].alias("party"),
                    F.try_to_date(F.try_element_at("terms", F.lit(1))["start"], "yyyy-MM-dd").alias("served_from"), F.try_to_date(last["end"], "yyyy-MM-dd").alias("served_until"), F.to_json("id").alias("ids"))


COMMITTEE = "thomas_id string, name string, type string, url string, subcommittees array<struct<thomas_id:string,name:string>>"


def committees(spark: SparkSession, path: str | list[str]) -> DataFrame:
    c = spark.read.schema(COMMITTEE).json(path)
    main = c.select(F.col("thomas_id").alias("committee_code"), "name", F.col("type").alias("chamber"), F.lit(None).cast("string").alias("parent_code"), "url")
    sub = c.select("*", F.explode("subcommittees").alias("s")).select(F.concat("thomas_id", "s.thomas_id").alias("committee_code"), F.col("s.name").alias("name"), F.col("type").alias("chamber"), F.col("thomas_id").alias("parent_code"), F.lit(None).cast("string").alias("url"))
    return main.unionByName(sub)


def committee_members(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Assignments of a landed map from committee to members."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<struct<bioguide:string,party:string,rank:int,title:string>>>").alias("m"))
    each = rows.select(F.explode("m").alias("committee_code", "ms")).select("committee_code", F.explode("ms").alias("m"))
    return each.select(F.col("m.bioguide").alias("bioguide_id"), "committee_code", "m.party", F.col("m.rank").alias("rank_in_party"), "m.title").filter(F.col("bioguide_id").isNotNull())


SOCIAL = "id struct<bioguide:string>, social struct<twitter:string,twitter_id:string,youtube:string,youtube_id:string,instagram:string,instagram_id:string,facebook:string>"


def social_handles(spark: SparkSession, path: str | list[str]) -> DataFrame:
    s = spark.read.schema(SOCIAL).json(path).select(F.col("id.bioguide").alias("bioguide_id"), "social.*")
    s = s.withColumns({c: F.col(c).try_cast("bigint") for c in ("twitter_id", "instagram_id")})
    return s.filter(F.coalesce(*[F.col(c).cast("string") for c in s.columns[1:]]).isNotNull())


PACKAGE = r"(?i)^BILLS-(\d+)(hr|s|hjres|sjres|hconres|sconres|hres|sres)(\d+)([a-z][a-z0-9]*)\.(?:xml|html?|pdf)$"


def text_listing(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The newest entry of each package of landed listings {"files": [...]}, with its bill and version; undated ones are the oldest."""
    files = spark.read.schema("files array<struct<name:string,formattedLastModifiedTime:string>>").option("multiLine", True).json(path).select(F.explode("files").alias("f")).select("f.*")
    part = lambda i: F.regexp_extract("name", PACKAGE, i)
    files = files.filter(F.col("name").rlike(PACKAGE)).select(F.regexp_replace("name", r"\.\w+$", "").alias("package"), F.concat_ws(":", part(1), F.lower(part(2)), part(3)).alias("bill_id"), F.lower(part(4)).alias("version_code"), "name", F.try_to_timestamp("formattedLastModifiedTime", F.lit("dd-MMM-yyyy HH:mm")).alias("last_modified"))
    return files.groupBy("package").agg(F.max(F.struct("last_modified", "name", "bill_id", "version_code")).alias("m")).select("package", "m.*")


def listed_texts(listing: DataFrame, landed: str, held: DataFrame, frontier: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(texts, frontier): rows of the table of texts that a listing (as text_listing gives it) has newly, and how far each slot is read.

    landed is the folder of the fetched bodies, {package}.htm or, if there is none, {package}.xml. A slot is a congress and
    type; frontier (slot, last_modified) says up to which moment its entries have been taken, and only later ones are (an
    undated one is, while its slot has no frontier). Versions that held (bill_id, version_code) has aren't read again. A body
    is cleaned to lines without a printed page's furniture; one without any line is left out. The new frontier has each
    slot's latest entry, with or without a usable body, and never goes back.
    """
    from ..text.clean import text_lines

    root = landed.rstrip("/")
    slot = F.regexp_extract("bill_id", "^([^:]+:[^:]+):", 1)
    seen = frontier.select(F.col("slot"), F.col("last_modified").alias("__seen"))
    later = listing.withColumn("slot", slot).join(seen, "slot", "left").filter(F.col("__seen").isNull() | (F.col("last_modified") > F.col("__seen")))
    todo = later.join(held.select("bill_id", "version_code").distinct(), ["bill_id", "version_code"], "left_anti")
    todo = todo.select("bill_id", "version_code", "package", "last_modified", *[F.concat(F.lit(f"{root}/"), "package", F.lit(e)).alias("__" + e[1:]) for e in (".htm", ".xml")])
    read = texttree.first_text(todo, ["__htm", "__xml"], "__raw", "source_url").filter("__raw IS NOT NULL")
    lines = read.withColumn("__lines", text_lines(F.col("__raw"), furniture=True)).filter("__lines <> ''")
    body = F.concat("__lines", F.lit("\n"))
    code = F.col("version_code")
    texts = lines.select("bill_id", code, tables.version_label(code, code).alias("version_label"), body.alias("body"), F.size(F.split("__lines", "\n")).alias("line_count"), F.sha2(body, 256).alias("sha256"), "package", "source_url", "last_modified", (F.current_timestamp() if now is None else now).alias("fetched_at"))
    ends = later.groupBy("slot").agg(F.max("last_modified").alias("last_modified")).unionByName(frontier.select("slot", "last_modified"))
    return texts, ends.groupBy("slot").agg(F.max("last_modified").alias("last_modified")).filter("last_modified IS NOT NULL")


BILL = "bill struct<congress:int,type:string,number:string,title:string,introducedDate:string,sponsors:array<struct<bioguideId:string>>,latestAction:struct<text:string,actionDate:string>,policyArea:struct<name:string>,cosponsors:struct<count:int>>"


def bill_details(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of the table of bills from landed details {"bill": ...}; of a bill that is there twice that with the latest action."""
    b = spark.read.schema(BILL).json(path).select("bill.*")
    day = lambda c: F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")
    rows = b.select(F.concat_ws(":", F.col("congress").cast("string"), F.lower("type"), "number").alias("bill_id"), "congress", F.lower("type").alias("bill_type"), F.col("number").try_cast("int").alias("number"), "title", F.try_element_at("sponsors", F.lit(1))["bioguideId"].alias("sponsor_bioguide"),
                    day(F.col("introducedDate")).alias("introduced_date"), day(F.col("latestAction.actionDate")).alias("latest_action_date"), F.col("latestAction.text").alias("latest_action_text"), F.col("policyArea.name").alias("policy_area"), F.coalesce("cosponsors.count", F.lit(0)).alias("cosponsor_count"))
    return latest_per_key(rows, ["bill_id"], [F.col("latest_action_date")])


PARTS = """request struct<congress:int,billType:string,billNumber:string>, cosponsors array<struct<bioguideId:string,sponsorshipDate:string,isOriginalCosponsor:boolean>>,
actions array<struct<actionDate:string,actionCode:string,type:string,text:string,committees:array<struct<name:string>>>>"""


def bill_parts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Events of landed pages of a bill's cosponsors or actions, which name the bill in their request."""
    p = spark.read.schema(PARTS).json(path).withColumn("bill_id", F.concat_ws(":", F.col("request.congress").cast("string"), F.lower("request.billType"), "request.billNumber"))
    c = p.select("bill_id", F.explode("cosponsors").alias("c"))
    held = as_events(c, "congress_bills", F.concat_ws(":", F.lit("cosponsor"), "bill_id", "c.bioguideId"), F.concat(F.lit("bioguide:"), "c.bioguideId"), "bill.cosponsored", civic.iso_time(F.col("c.sponsorshipDate")), [F.col("bill_id"), F.col("c.isOriginalCosponsor").alias("is_original")])
    a = p.select("bill_id", F.explode("actions").alias("a"))
    key = F.concat_ws(":", F.lit("action"), "bill_id", "a.actionDate", "a.actionCode", F.substring(F.sha2(F.coalesce("a.text", F.lit("")), 256), 1, 12))
    done = as_events(a, "congress_bill_actions", key, F.concat(F.lit("bill:"), "bill_id"), "bill.action", civic.iso_time(F.col("a.actionDate")), [F.col("bill_id"), F.col("a.actionCode").alias("action_code"), F.col("a.type").alias("action_type"), F.col("a.text").alias("text"), F.col("a.committees.name").alias("committees")])
    return held.unionByName(done)


TOTALS = "results array<struct<candidate_id:string,cycle:int,receipts:string,disbursements:string,last_cash_on_hand_end_period:string,last_debts_owed_by_committee:string,individual_contributions:string,coverage_start_date:string,coverage_end_date:string,last_report_type_full:string>>"


def funding_totals(spark: SparkSession, path: str | list[str], resolved: DataFrame) -> DataFrame:
    """Rows of the table of totals from landed pages, by resolved ids (bioguide_id, cycle, fec_id); those of unknown candidates are left out."""
    t = spark.read.schema(TOTALS).json(path).select(F.explode("results").alias("t")).select("t.*")
    money = lambda c, name: F.col(c).try_cast("decimal(18,3)").alias(name)
    day = lambda c: F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")
    rows = t.select(F.col("candidate_id").alias("fec_id"), "cycle", money("receipts", "receipts"), money("disbursements", "disbursements"), money("last_cash_on_hand_end_period", "cash_on_hand"), money("last_debts_owed_by_committee", "debts"), money("individual_contributions", "individual"),
                    day(F.col("coverage_start_date")).alias("coverage_start"), day(F.col("coverage_end_date")).alias("coverage_end"), F.col("last_report_type_full").alias("last_report_label"))
    return rows.join(resolved.filter(F.col("fec_id").isNotNull()), ["fec_id", "cycle"])


def resolved_candidates(members: DataFrame, cached: DataFrame, by_name: DataFrame) -> DataFrame:
    """(bioguide_id, cycle, fec_id, source) of members (bioguide_id, cycle, fec_ids, name, state): what the cache says, a null too, else the first id of their own, else the only candidate of that name and state."""
    only = by_name.groupBy(F.lower("name").alias("__name"), "state").agg(F.max("fec_id").alias("__found"), F.count_distinct("fec_id").alias("__n")).filter("__n = 1")
    known = cached.select("bioguide_id", "cycle", F.col("fec_id").alias("__cached"), F.lit(True).alias("__is_cached"))
    m = members.join(known, ["bioguide_id", "cycle"], "left").join(only, (F.lower(members["name"]) == F.col("__name")) & (members["state"] == only["state"]), "left")
    own = F.try_element_at("fec_ids", F.lit(1))
    source = F.when(F.col("__is_cached"), "cached").when(own.isNotNull(), "primary").when(F.col("__found").isNotNull(), "name").otherwise("none")
    return m.select("bioguide_id", "cycle", F.when(F.col("__is_cached"), F.col("__cached")).otherwise(F.coalesce(own, "__found")).alias("fec_id"), source.alias("source"))


def bill_texts(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the table of texts from the tree {congress}/{type}/{number}: a row for each version that has an entry and a text."""
    return texttree.ingested(spark, root)


def landed(spark: SparkSession, roots: list[str], name: str, schema: str) -> DataFrame:
    """A table of that name from every root that has it: none of the roots need have it, and it is empty then."""
    found = []
    for root in roots:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            found.append(f"{root}/{name}")
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)
