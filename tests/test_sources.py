import json

from quorum.sources import ratings, readers


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return f"file://{tmp_path / name}"


def member(i, party, vote):
    return f'<recorded-vote><legislator name-id="{i}" party="{party}" state="AL">X</legislator><vote>{vote}</vote></recorded-vote>'


def test_house_votes(spark, tmp_path):
    votes = "".join(member(*m) for m in (("A1", "D", "No"), ("A2", "D", "Yea"), ("A3", "D", "Aye"), ("A4", "D", "Nay"), ("B1", "R", "Present"), ("B2", "R", "Not Voting")))
    path = put(tmp_path, "1.xml", f'<rollcall-vote><vote-metadata><congress>119</congress><session>1st</session><rollcall-num>7</rollcall-num><legis-num>H R 12</legis-num><action-date>09-Jan-2025</action-date><action-time time-etz="18:30">6:30 PM</action-time></vote-metadata><vote-data>{votes}</vote-data></rollcall-vote>')
    found = {r.entity_id: (r.event_type, json.loads(r.payload)["party_line"], str(r.occurred_at)) for r in readers.house_votes(spark, path).collect()}
    assert {k: v[:2] for k, v in found.items()} == {"bioguide:A1": ("vote.cast", True), "bioguide:A2": ("vote.cast", False), "bioguide:A3": ("vote.cast", False), "bioguide:A4": ("vote.cast", True), "bioguide:B1": ("vote.cast", None), "bioguide:B2": ("vote.missed", None)}


def test_senate_votes(spark, tmp_path):
    who = "".join(f"<member><lis_member_id>{i}</lis_member_id><last_name>{n}</last_name><state>{s}</state><party>R</party><vote_cast>Yea</vote_cast></member>" for i, n, s in (("S1", "Able", "OH"), ("S9", "Baker", "UT"), ("S8", "Nobody", "ZZ")))
    path = put(tmp_path, "s.xml", f"<roll_call_vote><congress>119</congress><session>1</session><vote_number>3</vote_number><vote_date>February 4, 2025, 03:30 PM</vote_date><document><document_type>S.</document_type><document_number>5</document_number></document><members>{who}</members></roll_call_vote>")
    index = spark.createDataFrame([("S1", "A000001", "Able", "OH"), (None, "B000002", "Baker", "UT")], "lis string, bioguide string, last_name string, state string")
    assert {r.entity_id for r in readers.senate_votes(spark, path, index).collect()} == {"bioguide:A000001", "bioguide:B000002"}


def test_bill_status(spark, tmp_path):
    path = put(tmp_path, "b.xml", """<billStatus><bill><congress>119</congress><type>HR</type><number>12</number><title>T</title><introducedDate>2025-01-03</introducedDate><latestAction><text>Referred</text><actionDate>2025-01-04</actionDate></latestAction>
<sponsors><item><bioguideId>A1</bioguideId></item></sponsors><cosponsors><item><bioguideId>A2</bioguideId><sponsorshipDate>2025-01-05</sponsorshipDate><isOriginalCosponsor>True</isOriginalCosponsor></item></cosponsors>
<actions><item><actionDate>2025-01-04</actionDate><actionCode>H1</actionCode><type>Intro</type><text>Referred</text><committees><item><name>C</name></item></committees></item></actions></bill></billStatus>""")
    bills, events = readers.bill_status(spark, path)
    assert [(r.bill_id, r.sponsor_bioguide, r.cosponsor_count) for r in bills.collect()] == [("119:hr:12", "A1", 1)]
    assert sorted((r.event_type, r.entity_id) for r in events.collect()) == [("bill.action", "bill:119:hr:12"), ("bill.cosponsored", "bioguide:A2"), ("bill.sponsored", "bioguide:A1")]


def test_lobbying(spark, tmp_path):
    page = {"results": [{"filing_uuid": "u", "filing_year": 2025, "filing_period": "q1", "dt_posted": "2025-04-01T00:00:00Z", "income": None, "expenses": "90", "registrant": {"id": 1, "name": "R"}, "client": {"id": 2, "name": "C"}, "lobbying_activities": [{"general_issue_code": "TAX", "description": "H.R. 1, S. 2"}, {"general_issue_code": "AGR", "description": "HR 1; H.Res. 3"}]}]}
    filings, events = readers.lobbying_filings(spark, put(tmp_path, "l.json", json.dumps(page)))
    assert filings.first().bill_refs == ["119:hr:1", "119:hres:3", "119:s:2"] and filings.first().issue_codes == ["AGR", "TAX"]
    assert [json.loads(r.payload)["amount_share"] for r in events.collect()] == [30.0] * 3


def test_speeches(spark, tmp_path):
    (tmp_path / "day=2025-01-10").mkdir()
    put(tmp_path / "day=2025-01-10", "m.xml", """<mods xmlns="http://www.loc.gov/mods/v3" xmlns:xlink="http://www.w3.org/1999/xlink"><relatedItem type="constituent"><titleInfo><title> T </title></titleInfo><identifier type="preferred citation">171 Cong. Rec. H1</identifier><part><extent><start>H1</start><end>H2</end></extent></part>
<extension><granuleClass>HOUSE</granuleClass><accessId>G1</accessId><congMember bioGuideId="A1" congress="119" role="SPEAKING" party="D" state="OH"/><congMember bioGuideId="A2" congress="x"/><congMember bioGuideId=" "/>
<isReferringTo type="bill" ID="119hr1"/><isReferringTo type="usc" ID="42"/><isReferringTo type="other" ID="BILL-5"/><isReferringTo type="law" xlink:href="#l"/><isReferringTo type="publiclaw"> Public Law 1 </isReferringTo></extension></relatedItem>
<relatedItem type="constituent"><titleInfo><title>Digest</title></titleInfo><extension><granuleClass>DAILYDIGEST</granuleClass><accessId>G2</accessId><congMember bioGuideId="A1"/></extension></relatedItem>
<relatedItem type="constituent"><extension><granuleClass>SENATE</granuleClass><accessId>G3</accessId></extension></relatedItem>
<relatedItem type="host"><extension><granuleClass>SENATE</granuleClass><accessId>G4</accessId><congMember bioGuideId="A1"/></extension></relatedItem>
<relatedItem type="constituent"><extension><granuleClass>Extensions</granuleClass><accessId>G5</accessId><congMember bioGuideId="A3" role="RECORDER"/></extension></relatedItem></mods>""")
    rows = {r.source_id: r for r in readers.floor_speeches(spark, f"file://{tmp_path}").collect()}
    assert sorted(rows) == ["G1:A1", "G1:A2", "G5:A3"] and {str(r.occurred_at) for r in rows.values()} == {"2025-01-10 12:00:00"}
    first, second, third = (json.loads(rows[k].payload) for k in sorted(rows))
    assert (first["citation"], first["title"], first["chamber"], first["congress"], first["page_start"], first["page_end"], first["speaker_count"]) == ("171 Cong. Rec. H1", "T", "house", 119, "H1", "H2", 3)
    assert first["bill_refs"] == [{"type": "bill", "ref": "119hr1"}, {"type": "other", "ref": "BILL-5"}, {"type": "law", "ref": "#l"}, {"type": "publiclaw", "ref": "Public Law 1"}]
    assert first["granule_url"].endswith("/CREC-2025-01-10/G1") and second["congress"] is None and second["party"] == "" and third["bill_refs"] is None and third["chamber"] == "extensions"


def test_json_tables(spark, tmp_path):
    m = {"committeeMeeting": {"eventId": "9", "congress": 119, "chamber": "House", "date": "2025-02-01T10:00:00Z", "committees": [], "witnesses": [{"name": "W"}]}}
    assert sorted((r.event_type, r.entity_id) for r in readers.committee_meetings(spark, put(tmp_path, "m.json", json.dumps(m))).collect()) == [("committee.meeting", "chamber:house"), ("committee.witness", "chamber:house")]
    a = {"amendment": {"congress": 119, "type": "SAMDT", "number": 4, "sponsors": [{"bioguideId": "A1"}], "submittedDate": "2025-01-02", "amendedBill": {"congress": 119, "type": "HR", "number": "1"}}}
    assert json.loads(readers.amendments(spark, put(tmp_path, "a.json", json.dumps(a))).first().payload)["bill_id"] == "119:hr:1"
    s = {"summaries": [{"bill": {"congress": 119, "type": "HR", "number": "1"}, "versionCode": "00", "actionDate": "2025-01-02", "text": "<p>Hi <b>you</b></p>", "updateDate": "2025-01-03"}]}
    assert readers.bill_summaries(spark, put(tmp_path, "s.json", json.dumps(s))).first().summary_text == "Hi you"
    p = {"id": {"bioguide": "A1"}, "name": {"first": "F", "last": "L"}, "terms": [{"type": "rep", "start": "2019-01-03", "end": "2021-01-03", "state": "OH", "district": 1, "party": "D"}, {"type": "sen", "start": "2021-01-03", "end": "2027-01-03", "state": "OH", "party": "D"}]}
    r = readers.legislators(spark, put(tmp_path, "p.json", json.dumps(p))).first()
    assert (r.chamber, r.full_name, str(r.served_from), str(r.served_until)) == ("senate", "F L", "2019-01-03", "2027-01-03")
    c = {"thomas_id": "HSAG", "name": "Agriculture", "type": "house", "subcommittees": [{"thomas_id": "15", "name": "Sub"}]}
    assert {(x.committee_code, x.parent_code) for x in readers.committees(spark, put(tmp_path, "c.json", json.dumps(c))).collect()} == {("HSAG", None), ("HSAG15", "HSAG")}
    assert readers.committee_members(spark, put(tmp_path, "cm.json", json.dumps({"HSAG": [{"bioguide": "A1", "rank": 1, "title": "Chair"}]}))).first().title == "Chair"
    h = "\n".join(json.dumps(x) for x in ({"id": {"bioguide": "A1"}, "social": {"twitter": "t", "twitter_id": "x"}}, {"id": {"bioguide": "A2"}, "social": {}}))
    assert [x.bioguide_id for x in readers.social_handles(spark, put(tmp_path, "h.json", h)).collect()] == ["A1"]
    f = {"files": [{"name": "BILLS-119hr1234ih.xml", "formattedLastModifiedTime": "10-Jan-2025 20:36"}, {"name": "BILLS-119hr1234ih.htm", "formattedLastModifiedTime": "09-Jan-2025 20:36"}, {"name": "x.txt"}]}
    assert [(x.bill_id, x.version_code, x.name) for x in readers.text_listing(spark, put(tmp_path, "f.json", json.dumps(f))).collect()] == [("119:hr:1234", "ih", "BILLS-119hr1234ih.xml")]
    odd = [("BILLS-119hr1234eh1s.xml", "10-Jan-2025 20:36"), ("bills-119S5ES2.HTM", ""), ("BILLS-119hconres7rfs2.pdf", "11-Jan-2025 00:00"), ("BILLS-119hr1234.xml", "11-Jan-2025 00:00"), ("BILLS-119xx1ih.xml", "x"), ("BILLS-119hjres1ih.doc", "x")]
    f = {"files": [{"name": n, "formattedLastModifiedTime": t} for n, t in odd]}
    assert {(x.bill_id, x.version_code) for x in readers.text_listing(spark, put(tmp_path, "g.json", json.dumps(f))).collect()} == {("119:hr:1234", "eh1s"), ("119:s:5", "es2"), ("119:hconres:7", "rfs2")}


def test_ratings(spark, tmp_path):
    page = '<table class="wikitable"><tr><th>District</th><th>PVI</th></tr><tr><td>Alabama&nbsp;1</td><td>R+5</td></tr><tr><td>Alaska at-large</td><td>EVEN</td></tr><tr><td>West Virginia 2</td><td>D+3</td></tr></table>'
    found = {(r.state, r.district): (r.pvi, r.score) for r in ratings.district_ratings(spark, put(tmp_path, "p.html", page), 119).collect()}
    assert found == {("AL", 1): ("R+5", 5), ("AK", 0): ("EVEN", 0), ("WV", 2): ("D+3", -3)}
    states = '<table class="wikitable"><tr><th>State</th><th>PVI</th></tr><tr><td>Ohio</td><td>R+5</td></tr></table>'
    found = {(r.state, r.district) for r in ratings.district_ratings(spark, put(tmp_path, "both.html", states + page + states.replace("</table>", "<tr><td>Utah</td><td>R+9</td></tr></table>")), 119).collect()}
    assert found == {("AL", 1), ("AK", 0), ("WV", 2), ("OH", -1), ("UT", -1)}


def test_bills_by_json(spark, tmp_path):
    bill = {"bill": {"congress": 119, "type": "HR", "number": "12", "title": "T", "introducedDate": "2025-01-03", "sponsors": [{"bioguideId": "A1"}], "latestAction": {"text": "x", "actionDate": "2025-01-04"}}}
    later = {"bill": {**bill["bill"], "latestAction": {"text": "y", "actionDate": "2025-02-04"}}}
    r = readers.bill_details(spark, put(tmp_path, "b.json", json.dumps(bill) + "\n" + json.dumps(later))).collect()
    assert [(x.bill_id, x.latest_action_text, x.sponsor_bioguide, x.cosponsor_count) for x in r] == [("119:hr:12", "y", "A1", 0)]
    q = {"congress": 119, "billType": "HR", "billNumber": "12"}
    parts = [{"request": q, "cosponsors": [{"bioguideId": "A2", "sponsorshipDate": "2025-01-05", "isOriginalCosponsor": True}]}, {"request": q, "actions": [{"actionDate": "2025-01-06", "actionCode": "H1", "text": "Referred"}]}]
    assert sorted((x.event_type, x.entity_id) for x in readers.bill_parts(spark, put(tmp_path, "p.json", "\n".join(map(json.dumps, parts)))).collect()) == [("bill.action", "bill:119:hr:12"), ("bill.cosponsored", "bioguide:A2")]


def test_funding(spark, tmp_path):
    members = spark.createDataFrame([("A", 2024, ["H1"], "Ann", "OH"), ("B", 2024, None, "Bob", "UT"), ("C", 2024, ["H3"], "Cy", "OH"), ("D", 2024, None, "Di", "OH")], "bioguide_id string, cycle int, fec_ids array<string>, name string, state string")
    cached = spark.createDataFrame([("C", 2024, None)], "bioguide_id string, cycle int, fec_id string")
    names = spark.createDataFrame([("BOB", "UT", "H2"), ("Di", "OH", "H5"), ("Di", "OH", "H6")], "name string, state string, fec_id string")
    found = readers.resolved_candidates(members, cached, names)
    assert {(r.bioguide_id, r.fec_id, r.source) for r in found.collect()} == {("A", "H1", "primary"), ("B", "H2", "name"), ("C", None, "cached"), ("D", None, "none")}
    page = {"results": [{"candidate_id": c, "cycle": 2024, "receipts": "12.5", "coverage_end_date": "2024-12-31T00:00:00"} for c in ("H1", "H9")]}
    rows = readers.funding_totals(spark, put(tmp_path, "f.json", json.dumps(page)), found).collect()
    assert [(r.bioguide_id, float(r.receipts), str(r.coverage_end)) for r in rows] == [("A", 12.5, "2024-12-31")]


def test_roots(spark, tmp_path):
    spark.range(3).write.parquet(f"file://{tmp_path}/a/t")
    assert [readers.landed(spark, [f"file://{tmp_path}/{r}" for r in roots], "t", "id long").count() for roots in (["a"], ["a", "b"], ["b"])] == [3, 3, 0]
