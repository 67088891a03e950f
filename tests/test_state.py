"""Cursors, caches, results by content, ratings, the runner: what is kept from one run to the next."""

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quorum.operators import cache, eventlog, matching, results, search
from quorum.sources import ratings, runner
from quorum.streaming import cursors

TODAY = date(2025, 3, 20)


def plain_advance(cursor, landed, horizon=4, most=None):
    """Day by day, as one would walk."""
    at, last = cursor, TODAY if most is None else min(TODAY, cursor + timedelta(days=most))
    gap = None
    day = cursor + timedelta(days=1)
    while day <= last:
        if day not in landed and day > TODAY - timedelta(days=horizon):
            gap = day
            break
        at, day = day, day + timedelta(days=1)
    return gap, at


@pytest.mark.parametrize("most", [None, 3, 30])
def test_safe_horizon(spark, most):
    back = lambda *ns: {TODAY - timedelta(days=n) for n in ns}
    cases = {
        "all": (20, back(*range(21))), "old gap": (20, back(19, 18, 3, 2, 1, 0)), "young gap": (20, back(19, 3, 1, 0)), "edge old": (20, back(3, 2, 1, 0)), "edge young": (20, back(4, 2, 1, 0)), "none": (30, set()),
        "today missing": (2, back(1)), "at today": (0, back(0)), "ahead": (-2, set()), "within": (2, back(1, 0)), "long ago": (4000, back(3, 2)),
    }
    held = spark.createDataFrame([(k, TODAY - timedelta(days=c)) for k, (c, _) in cases.items()], "source string, cursor date")
    landed = spark.createDataFrame([(k, d) for k, (_, ds) in cases.items() for d in ds for _ in range(2)], "source string, day date")
    plan = cursors.advanced(held, landed, F.lit(TODAY), most_days=most)
    got = {r.source: (r.first_gap, r.advance_to) for r in plan.collect()}
    assert got == {k: plain_advance(TODAY - timedelta(days=c), ds, most=most) for k, (c, ds) in cases.items()}
    if most is None:
        read = cursors.to_read(landed, plan, 2).distinct()
        want = {(k, d) for k, (c, ds) in cases.items() for d in ds if TODAY - timedelta(days=c + 2) < d <= got[k][1]}
        assert {(r.source, r.day) for r in read.collect()} == want


EVENT = "source string, source_id string, payload_hash string, occurred_at timestamp, page int"


def landed_files(spark, path, *batches):
    for rows in batches:
        spark.createDataFrame([(s, i, h, datetime(2025, 1, 1), p) for s, i, h, p in rows], EVENT).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("dies", ["_put_cursors", "_commit", "_put_rows"])
def test_batch_that_dies(spark, tmp_path, monkeypatch, dies):
    """Between rows and cursors, before the commit, or at once: the run after it has all rows once and cursors that fit them."""
    source, root, check = f"file://{tmp_path}/in", f"file://{tmp_path}/log", f"file://{tmp_path}/check"
    landed_files(spark, source, [("a", "1", "x", 1), ("a", "2", "x", 2), ("a", "1", "x", 1)], [("b", "1", "x", 7)])
    stream = lambda: spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(source)
    place = F.lpad(F.col("page").cast("string"), 6, "0")
    real, calls = getattr(cursors, dies), []

    def once(*a):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(*a)

    monkeypatch.setattr(cursors, dies, once)
    with pytest.raises(StreamingQueryException):
        cursors.append_committed(stream(), root, check, place).awaitTermination()
    seen = {(r.source, r.source_id) for r in cursors.committed_rows(spark, root, EVENT).collect()}
    ends = {r.source: r.cursor for r in cursors.committed_cursors(spark, root).collect()}
    assert len(cursors._commits(spark, root)) == 1 and (seen, ends) in [({("a", "1"), ("a", "2")}, {"a": "000002"}), ({("b", "1")}, {"b": "000007"})]
    cursors.append_committed(stream(), root, check, place).awaitTermination()
    landed_files(spark, source, [("a", "2", "x", 1), ("a", "3", "x", 1)])
    cursors.append_committed(stream(), root, check, place).awaitTermination()
    rows = cursors.committed_rows(spark, root, EVENT).collect()
    assert sorted((r.source, r.source_id) for r in rows) == [("a", "1"), ("a", "2"), ("a", "3"), ("b", "1")]
    assert {r.source: r.cursor for r in cursors.committed_cursors(spark, root).collect()} == {"a": "000002", "b": "000007"}  # never back
    cursors.append_committed(stream(), root, f"file://{tmp_path}/anew", place).awaitTermination()  # all files again, by another stream
    assert cursors.committed_rows(spark, root, EVENT).count() == 4


def test_committed_batch_is_not_repeated(spark, tmp_path):
    root = f"file://{tmp_path}/log"
    rows = spark.createDataFrame([("a", "1", "x", datetime(2025, 1, 1), 1)], EVENT)
    assert [cursors.commit_batch(rows, "s-0", root, F.col("page")) for _ in range(2)] == [True, False]
    assert cursors.committed_cursors(spark, f"file://{tmp_path}/none").count() == 0


def test_results_by_content(spark, tmp_path):
    asked = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "a", "x"), (4, None, "z")], "id int, key string, text string")
    seen, path, moment = [], f"file://{tmp_path}/store", lambda n: F.lit(datetime(2025, 1, n))

    def compute(rows):
        seen.append(sorted((r.key or "", r.text) for r in rows.collect()))
        return rows.select("key", F.upper("text").alias("big"))

    first = results.computed(asked, ["key"], path, compute, moment(1))
    assert {(r.id, r.big) for r in first.collect()} == {(1, "X"), (2, "Y"), (3, "X"), (4, "Z")} and seen == [[("", "z"), ("a", "x"), ("b", "y")]]
    second = results.computed(asked.filter("id < 3"), ["key"], path, compute, moment(2))
    assert {(r.id, r.big) for r in second.collect()} == {(1, "X"), (2, "Y")} and len(seen) == 1  # nothing computed
    assert "upper" not in second._jdf.queryExecution().toString()
    changed = asked.withColumn("key", F.when(F.col("id") == 2, "b2").otherwise(F.col("key"))).withColumn("text", F.when(F.col("id") == 2, "new").otherwise(F.col("text")))
    third = results.computed(changed, ["key"], path, compute, moment(3))
    assert {(r.id, r.big) for r in third.collect()} == {(1, "X"), (2, "NEW"), (3, "X"), (4, "Z")} and seen[1:] == [[("b2", "new")]]  # its own pair only
    results.computed(asked.filter("id = 1"), ["key"], path, compute, moment(4))
    assert results.evict(spark, path, ["key"], 3) == 3  # b was used last on the second day
    again = results.computed(asked, ["key"], path, compute, moment(5))
    assert {(r.id, r.big) for r in again.collect()} == {(1, "X"), (2, "Y"), (3, "X"), (4, "Z")} and seen[2:] == [[("b", "y")]]
    assert results.evict(spark, f"file://{tmp_path}/none", ["key"], 3) == 0
    none = results.computed(asked.limit(0), ["key"], f"file://{tmp_path}/empty", compute, moment(1))
    assert none.count() == 0 and len(seen) == 3


def test_cache_by_time(spark):
    at = lambda d: datetime(2025, 1, d)
    entries = [("hit", "old", 1, 30), ("hit", "new", 5, 30), ("later", "x", 20, 30), ("over", "x", 1, 10), ("none", None, 2, None), ("back", None, 2, 30), ("back", "found", 3, 30), ("gone", "found", 2, 30), ("gone", None, 3, 30), (None, "x", 1, 30), ("renewed", "x", 1, 5), ("renewed", "y", 6, None)]
    held = spark.createDataFrame([(k, p, at(f), e and at(e)) for k, p, f, e in entries], "key string, payload string, fetched_at timestamp, expires_at timestamp")
    asked = spark.createDataFrame([(k,) for k in ["hit", "hit", "later", "over", "none", "back", "gone", "never", None, "renewed"]], "key string")
    got = sorted((r.key or "", r.payload, r.state) for r in cache.looked_up(asked, held, "key", F.lit(at(10))).collect())
    assert got == sorted([("hit", "new", "hit")] * 2 + [("later", None, "missing"), ("over", None, "expired"), ("none", None, "negative"), ("back", "found", "hit"), ("gone", None, "negative"), ("never", None, "missing"), ("", None, "missing"), ("renewed", "y", "hit")])
    rows = spark.createDataFrame([(1, "s", "u", 1), (1, "s", "v", 2), (1, "s", None, 3), (2, "s", None, 1), (1, "l", "w", 1)], "id int, size string, url string, at int")
    assert {tuple(r) for r in cache.hydrated(rows, ["id", "size"], "url", "at").collect()} == {(1, "s", "v"), (1, "l", "w")}


def test_collapse(spark):
    rows = [(1, "d", "Referred ", "api", ["X"], 5), (1, "d", " Referred", "bulk", ["Y", "X", None], 9), (1, "d", "Referred", "api", None, 7), (1, "e", "Referred", "api", [], 8), (2, None, None, None, None, 1), (2, None, None, "api", ["Z", "Z"], 2)]
    df = spark.createDataFrame(rows, "bill int, day string, text string, source string, committees array<string>, id int").repartition(4)
    one = eventlog.collapsed(df, [F.col("bill"), F.col("day"), F.trim("text").alias("words")], [-F.col("id")], {"sources": F.array("source"), "committees": F.col("committees")})
    got = {(r.bill, r.day, r.words): (r["head"].id, r.rows, r.sources, r.committees) for r in one.collect()}
    assert got == {(1, "d", "Referred"): (9, 3, ["bulk", "api"], ["Y", "X"]), (1, "e", "Referred"): (8, 1, ["api"], []), (2, None, None): (2, 2, ["api"], ["Z"])}


def test_added_columns_clash_with_none(spark):
    rows = spark.createDataFrame([(1, "a", 2, "x", 9.0), (1, "b", 1, "y", 1.0)], "k int, __added string, __row int, Q1 string, intensity double")
    assert [r["__added"] for r in eventlog.upserted(rows, rows, ["k"], [F.col("__row")]).collect()] == ["a"]
    assert eventlog.new_rows(rows.coalesce(1), None, ["k"]).first()["__added"] == "a"
    from quorum.operators.grids import banded

    assert banded(rows.withColumnRenamed("__row", "top"), ["k"]).columns == ["k", "__added", "top", "Q1", "intensity", "band"]


def test_ratings_by_bucket(spark, tmp_path):
    rows = [(119, f"S{i // 5}", i % 5 - 1, f"R+{i % 7}", i % 7) for i in range(200)] + [(118, "S1", 0, "EVEN", 0)]
    spark.createDataFrame(rows, "congress int, state string, district int, pvi string, score int").createOrReplaceTempView("rated")
    spark.sql("DROP TABLE IF EXISTS ratings_by_place")
    spark.sql("DROP TABLE IF EXISTS members_by_place")
    try:
        ratings.store(spark.table("rated"), "ratings_by_place", 8)
        known = spark.table("ratings_by_place")
        one = ratings.rating_of(known, 119, "S1", 0, "House")
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan tells
        assert "SelectedBucketsCount: 1 out of 8" in one._jdf.queryExecution().toString()
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        assert [tuple(r) for r in one.collect()] == [(r[3], r[4]) for r in rows if r[:3] == (119, "S1", 0)]
        assert ratings.rating_of(known, 119, "S1", 77, "House").count() == 0 and ratings.rating_of(known, 119, "S0", 3, "senate").count() == ratings.rating_of(known, 119, "S0", None, "x").count()
        members = spark.createDataFrame([(1, "S1", 0, "House"), (2, "S0", 9, "Senate"), (3, "S1", None, "House"), (4, "ZZ", 1, "House"), (5, None, 1, "House")], "id int, state string, district int, chamber string")
        members.withColumn("place", ratings.member_place(119)).write.bucketBy(8, "place").sortBy("place").saveAsTable("members_by_place")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        met = ratings.rated(spark.table("members_by_place"), known, 119)
        assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
        by = {(r[0], r[1], r[2]): r[3] for r in rows}
        assert {r.id: r.pvi for r in met.collect()} == {1: by[119, "S1", 0], 2: by.get((119, "S0", -1)), 3: by[119, "S1", 0], 4: None, 5: None}
        assert {r.id: r.pvi for r in ratings.rated(members, spark.table("rated"), 118).collect()} == {1: "EVEN", 2: None, 3: "EVEN", 4: None, 5: None}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS ratings_by_place")
        spark.sql("DROP TABLE IF EXISTS members_by_place")


def test_matching(spark):
    bills = spark.createDataFrame([("119:hr:1", "Clean Energy Jobs Act", "Energy"), ("119:hr:2", "Of the", "")], "bill_id string, title string, policy_area string")
    mention = "bill_id string, client_id string, client_name string, mention_text string, issue_codes array<string>, amount double, filing_year int, filing_period string"
    rows = [
        ("119:hr:1", "a", "A", "H.R. 1, Clean Energy Jobs tax", ["FUE"], 5.0, 2024, "fourth_quarter"), ("119:hr:1", "a", "A", "nothing of it", ["TAX", "ENG"], None, 2025, "first_quarter"), ("119:hr:1", "a", "A", "", ["TAX"], 1.0, 2025, "second_quarter"),
        ("119:hr:1", "b", None, "unrelated words", ["TAX"], 9.0, 2025, "x"), ("119:hr:1", "c", "C", None, None, 9.0, None, None), ("119:hr:9", "a", "A", "clean energy", ["ENG"], 1.0, 2025, "q"), (None, "a", "A", "x", None, 1.0, 1, "q"), ("119:hr:1", None, "N", "clean", ["ENG"], 1.0, 1, "q"),
    ]
    scores = matching.scored(spark.createDataFrame(rows, mention), bills)
    got = {(r.client_id, r.mention_text, r.bill_id): (round(r.score, 6), r.band, r.has_mention) for r in scores.collect()}
    assert got["a", "H.R. 1, Clean Energy Jobs tax", "119:hr:1"] == (0.875, "confident", True) and got["a", "", "119:hr:1"] == (0.15, "false_positive", False) and got["c", None, "119:hr:1"] == (0.375, "possible", False)
    assert got["b", "unrelated words", "119:hr:1"] == (0.0, "false_positive", True) and got["a", "clean energy", "119:hr:9"] == (0.1, "false_positive", True) and len(got) == 7
    shown = {(r.bill_id, r.client_id): r for r in matching.clients_of_bills(scores).collect()}
    assert set(shown) == {("119:hr:1", "a"), ("119:hr:1", "c")}
    a = shown["119:hr:1", "a"]
    assert (a.filings, a.amount, a.latest_period, a.issue_codes, round(a.best, 3), a.band, a.place) == (3, 6.0, "2025 Q2", ["ENG", "FUE", "TAX"], 0.875, "confident", 1) and shown["119:hr:1", "c"].latest_period == ""
    assert {r.band: (r.n, r.with_mention) for r in matching.bands(scores).collect()} == {"confident": (1, 1), "possible": (2, 1), "false_positive": (4, 3)}
    wrong = {(r.bill_id, r.example): (r.n, r.client_name, r.snippet) for r in matching.misfits(scores, ["client_name", "mention_text"], bills=1, examples=2).collect()}
    assert wrong == {("119:hr:1", 1): (3, "?", "unrelated words"), ("119:hr:1", 2): (3, "A", "")}


def test_search(spark):
    bills = spark.createDataFrame([(f"119:{t}:{n}", t, n, title, date(2025, 1, n)) for t, n, title in (("hr", 7, "Health"), ("s", 7, "Tax 12%"), ("sres", 12, "x"), ("hjres", 3, "on health"))], "bill_id string, bill_type string, number int, title string, active_at date")
    found = lambda q: [(r.bill_id, r["rank"]) for r in search.found_bills(bills, q, 9).collect()]
    assert found("H.R. 7") == found("hr7") == [("119:hr:7", 0)] and found("S.Res. 12") == [("119:sres:12", 0)] and found("12") == [("119:sres:12", 1), ("119:s:7", 2)] and found(" HEALTH") == [("119:hr:7", 2), ("119:hjres:3", 2)]
    assert found("7") == [] and found("12%") == [("119:s:7", 2)] and found("1_%") == []
    people = spark.createDataFrame([("A", "Ann Lee", "Lee", "OH", "senate"), ("B", "Bo Ohm", "Ohm", "UT", "house")], "member string, full_name string, last_name string, state string, chamber string")
    assert [r.member for r in search.found_members(people, "oh", 9).collect()] == ["B", "A"] and search.found_members(people, "o", 9).count() == 0
    with pytest.raises(KeyError):
        search.with_facets(bills, kind="other")


def put(path, name, value):
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(value if isinstance(value, str) else json.dumps(value))


def test_runner(spark, tmp_path):
    root, store = tmp_path / "landed", f"file://{tmp_path}/store"
    amendment = lambda n, day: {"amendment": {"congress": 119, "type": "SAMDT", "number": n, "sponsors": [{"bioguideId": "A1"}], "submittedDate": day}}
    for n, day in enumerate(["2025-03-01", "2025-03-10", "2025-03-14"]):
        put(root / "congress_amendments" / f"day={day}", "a.json", amendment(n, day))
    speech = '<mods><relatedItem type="constituent"><extension><granuleClass>HOUSE</granuleClass><accessId>G{0}</accessId><congMember bioGuideId="A1"/></extension></relatedItem></mods>'
    for day in ("2025-03-10", "2025-03-13", "2025-03-15"):
        put(root / "govinfo_crec" / f"day={day}", "m.xml", speech.format(day))
    person = {"id": {"bioguide": "A1", "lis": "S1"}, "name": {"first": "F", "last": "Able"}, "terms": [{"type": "sen", "start": "2021-01-03", "end": "2027-01-03", "state": "OH", "party": "D"}]}
    put(root / "legislators" / "day=2025-03-15", "p.json", person)
    vote = "<roll_call_vote><congress>119</congress><session>1</session><vote_number>3</vote_number><vote_date>February 4, 2025</vote_date><members><member><lis_member_id>S1</lis_member_id><last_name>Able</last_name><state>OH</state><party>R</party><vote_cast>Yea</vote_cast></member></members></roll_call_vote>"
    put(root / "senate_rollcalls" / "day=2025-03-02", "s.xml", vote)
    put(root / "govinfo_bill_text" / "day=2025-03-02", "l.json", {"files": [{"name": "BILLS-119hr1ih.xml", "formattedLastModifiedTime": "10-Jan-2025 20:36"}]})
    put(root / "govinfo_bill_text" / "bodies", "BILLS-119hr1ih.htm", "<p>text</p>")
    at = f"file://{root}"
    first = runner.run(spark, at, store, date(2025, 3, 15))
    assert first["senate_rollcalls"] == "needs legislators" and first["congress_amendments"] == "3 days" and first["govinfo_crec"] == "1 days" and first["legislators"] == "1 days"  # the 12th is missing and young: the Record waits
    assert first["events"] == "4" and eventlog.current(spark, f"{store}/bill_text").first().body == "text\n"
    assert set(first) == {*runner.SOURCES, "events"}
    again = runner.run(spark, at, store, date(2025, 3, 15))
    assert again["congress_amendments"] == "not due" and again["senate_rollcalls"] == "1 days" and again["events"] == "1"
    later = runner.run(spark, at, store, date(2025, 3, 16))
    assert later["congress_amendments"] == "1 days" and later["govinfo_crec"] == "1 days" and later["events"] == "1"  # four days behind the 14th, which is known; the 12th is final now, the 14th is not
    state = {r.source: (r.cursor, r.run_on) for r in eventlog.current(spark, f"{store}/state").collect()}
    assert state["govinfo_crec"] == (date(2025, 3, 13), date(2025, 3, 16)) and state["congress_amendments"][0] == date(2025, 3, 14) and state["congress_rollcalls"][0] is None
    assert spark.read.parquet(f"{store}/log").count() == 6


def test_planned_paths():
    days = [date(2025, 3, d) for d in (1, 5, 9, 10, 12)]
    source = runner.Source("s", None, overlap_days=4)
    run = runner.planned(source, days, (date(2025, 3, 10), date(2025, 3, 11)), set(), date(2025, 3, 12), "/r")
    assert run.paths == ("/r/s/day=2025-03-09", "/r/s/day=2025-03-10", "/r/s/day=2025-03-12") and run.cursor == date(2025, 3, 12)
    assert runner.planned(source, days, (None, None), set(), date(2025, 3, 9), "/r").paths[-1] == "/r/s/day=2025-03-09"
    assert runner.planned(runner.Source("w", None, cadence_days=7), days, (None, date(2025, 3, 6)), set(), date(2025, 3, 12), "/r").why == "not due"


def test_names_are_taken_once():
    from quorum.plans.registry import query

    def safe_horizon(spark, sf_dir):
        return None

    with pytest.raises(ValueError):
        query()(safe_horizon)
