import hashlib
import json
import os
import shutil
from datetime import UTC, datetime
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from quorum.sources import readers, texttree

ROWS = "bill_id string, version_code string, version_label string, body string, line_count int, sha256 string, package string, source_url string, last_modified timestamp, fetched_at timestamp"
DAY = datetime(2025, 1, 2, tzinfo=UTC)


def entry(code, body, **more):
    return {"version_code": code, "version_label": code, "package": f"p-{code}", "path": "x", "fetched_at": "2025-01-03T00:00:00+00:00", "source_url": "u", "last_modified": "2025-01-02T10:00:00Z", "sha256": hashlib.sha256(body.encode()).hexdigest(), "lines": body.count("\n")} | more


def put(root, bill, bodies, entries):
    folder = root / bill
    folder.mkdir(parents=True, exist_ok=True)
    for code, body in bodies.items():
        (folder / f"{code}.txt").write_text(body)
    (folder / "manifest.json").write_text(entries if isinstance(entries, str) else json.dumps(entries))


@pytest.fixture
def root(tmp_path):
    put(tmp_path / "t", "119/hr/1", {"ih": "house text\n", "eh1s": "amended\ntwice\n"}, [entry("ih", "house text\n"), entry("eh1s", "amended\ntwice\n"), entry("enr", "gone"), {"version_label": "no code"}])
    put(tmp_path / "t", "119/s/1", {"is": "senate text\n"}, [entry("is", "old"), entry("is", "senate text\n", last_modified="2025-02-02", sha256="", fetched_at=None, lines=None)])
    put(tmp_path / "t", "118/hjres/12", {"zz": "é\n"}, [entry("zz", "é\n", version_label="Some Label")])
    put(tmp_path / "t", "118/hr/3", {"ih": "x"}, "{not json")
    put(tmp_path / "t", "118/hr/4", {"ih": "x"}, {"version_code": "ih"})
    return f"file://{tmp_path}/t"


def keyed(df):
    return {(r.bill_id, r.version_code): r for r in df.collect()}


def test_tree_is_read(spark, root):
    rows = keyed(texttree.tree(spark, root, tasks=3))
    assert {k: r.body for k, r in rows.items()} == {("119:hr:1", "ih"): "house text\n", ("119:hr:1", "eh1s"): "amended\ntwice\n", ("119:s:1", "is"): "senate text\n", ("118:hjres:12", "zz"): "é\n"}
    assert [rows[k].version_label for k in sorted(rows)] == ["Some Label", "Engrossed (House) Amendment (Senate)", "Introduced (House)", "Introduced (Senate)"]
    assert (rows["119:s:1", "is"].line_count, rows["119:s:1", "is"].sha256, str(rows["119:s:1", "is"].last_modified)) == (0, "", "2025-02-02 00:00:00")
    assert rows["119:s:1", "is"].fetched_at is not None and str(rows["119:hr:1", "ih"].fetched_at) == "2025-01-03 00:00:00"
    assert len(keyed(texttree.tree(spark, root, bodies=False))) == 5  # the entry without a text, too
    assert texttree.tree(spark, root + "/nothing").count() == 0


def test_only_named_bills_are_listed(spark, root):
    one = texttree.tree(spark, root).filter("bill_id = '119:hr:1'")
    two = texttree.tree(spark, root).filter(F.col("bill_id").isin("119:s:1", "118:hjres:12", "119:hr:99", "odd"))
    assert set(keyed(one)) == {("119:hr:1", "ih"), ("119:hr:1", "eh1s")} and set(keyed(two)) == {("119:s:1", "is"), ("118:hjres:12", "zz")}
    assert one.rdd.getNumPartitions() == 1 and two.rdd.getNumPartitions() == 3


def test_only_new_texts_are_opened(spark, root):
    first = texttree.ingested(spark, root).persist()
    assert first.count() == 4 and readers.bill_texts(spark, root).count() == 4
    for dir_, _, names in os.walk(root.removeprefix("file://")):
        for n in names:
            if n in ("ih.txt", "eh1s.txt", "zz.txt"):
                os.remove(f"{dir_}/{n}")  # what is held isn't opened again; what has no digest is
    put_back = keyed(texttree.ingested(spark, root, first))
    assert set(put_back) == {("119:s:1", "is")}
    changed = first.withColumn("sha256", F.when(F.col("version_code") == "zz", "other").otherwise(F.col("sha256")))
    assert set(keyed(texttree.ingested(spark, root, changed))) == {("119:s:1", "is")}  # new, but its text is gone
    first.unpersist()


def texts(spark, *rows):
    return spark.createDataFrame([(b, c, c, body, 1, "", "p", "u", at, DAY) for b, c, body, at in rows], ROWS)


def manifest(root, bill):
    with open(f"{root.removeprefix('file://')}/{bill}/manifest.json") as f:
        return json.load(f)


def test_round_trip(spark, tmp_path, root):
    later = datetime(2025, 3, 1, tzinfo=UTC)
    rows = texts(spark, ("119:hr:1", "ih", "new house text\nmore", later), ("119:hr:1", "enr", "enrolled", DAY), ("119:hr:1", "enr", "enrolled, later", later), ("119:hr:1", "zz", "z", None), ("120:s:1", "is", "é\n", DAY), ("120:s:1", "rs", "r", DAY), ("bad", "ih", "x", DAY), ("1:s:2", None, "x", DAY), ("1:s:2", "ih", None, DAY), ("1:s:../2", "a/b", "x", DAY))
    assert texttree.write_tree(rows, root) == 5
    got = {k: r.body for k, r in keyed(texttree.tree(spark, root)).items()}
    assert got[("119:hr:1", "ih")] == "new house text\nmore" and got[("119:hr:1", "enr")] == "enrolled, later" and got[("119:hr:1", "eh1s")] == "amended\ntwice\n" and got[("120:s:1", "is")] == "é\n" and got[("119:s:1", "is")] == "senate text\n" and len(got) == 8
    assert [e["version_code"] for e in manifest(root, "119/hr/1")] == ["ih", "enr", "eh1s", "zz"]
    e = manifest(root, "119/hr/1")[0]
    assert (e["sha256"], e["lines"]) == (hashlib.sha256(b"new house text\nmore").hexdigest(), 2) and e["path"].endswith("119/hr/1/ih.txt")
    again = texttree.tree(spark, root).filter("bill_id like '12%'")
    assert texttree.write_tree(again, f"file://{tmp_path}/copy") == 2
    old, new = keyed(again), keyed(texttree.tree(spark, f"file://{tmp_path}/copy"))
    assert {k: (r.body, r.sha256, r.last_modified) for k, r in old.items()} == {k: (r.body, r.sha256, r.last_modified) for k, r in new.items()}
    assert sorted(os.listdir(f"{tmp_path}/copy/{texttree.STAGED}") + os.listdir(f"{tmp_path}/copy/{texttree.COMMITS}")) == []
    assert texttree.write_tree(rows.limit(0), root) == 0 and texttree.published(spark, f"file://{tmp_path}/none") == 0


def test_a_write_that_dies(spark, tmp_path, root):
    """Nothing shows before it is published; what an earlier or dead try has left is neither shown nor in the way; publishing may be repeated from any point."""
    path = root.removeprefix("file://")
    before = {k: r.body for k, r in keyed(texttree.tree(spark, root)).items()}
    rows = texts(spark, ("119:hr:1", "ih", "second", DAY), ("119:hr:1", "rh", "reported", DAY), ("119:s:1", "is", "second", DAY))
    writer = texttree.TreeWriter({"path": root})
    first = writer.write(iter(rows.filter("bill_id = '119:hr:1'").collect()))  # a try of a task that is lost
    second = writer.write(iter(rows.filter("bill_id = '119:hr:1'").collect()))
    third = writer.write(iter(rows.filter("bill_id = '119:s:1'").collect()))
    assert {k: r.body for k, r in keyed(texttree.tree(spark, root)).items()} == before
    texttree.published(spark, root)
    assert {k: r.body for k, r in keyed(texttree.tree(spark, root)).items()} == before
    shutil.rmtree(f"{path}/{texttree.STAGED}/{first.attempt}")
    writer.commit([second, third, None])
    fs, base = texttree.opened(root)
    shutil.copytree(f"{path}/{texttree.STAGED}", f"{tmp_path}/staged")
    texttree._placed(fs, base, "119/hr/1", [second.attempt])  # a publication that died after its first bill
    assert texttree.published(spark, root) == 3
    got = {k: r.body for k, r in keyed(texttree.tree(spark, root)).items()}
    assert got == before | {("119:hr:1", "ih"): "second", ("119:hr:1", "rh"): "reported", ("119:s:1", "is"): "second"}
    other = texttree.TreeWriter({"path": root})
    other.write(iter(rows.collect()))
    other.abort([])
    assert not os.path.exists(f"{path}/{texttree.STAGED}/{other.run}")


class _Plain(HTMLParser):
    """The brute-force walk's own way from HTML to text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "head")
        self.out += ["\n"] if tag in ("p", "div", "br", "li", "pre", "h1") else []

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "head")
        self.out += ["\n"] if tag in ("p", "div", "br", "li", "pre", "h1") else []

    def handle_data(self, data):
        self.out += [] if self.skip > 0 else [data]


def plain_lines(raw):
    parser = _Plain()
    parser.feed(raw)
    lines = []
    for line in "".join(parser.out).split("\n"):
        line = " ".join(line.split())
        if line.isdigit() or line.lower().startswith("page 1"):
            continue
        if line or (lines and lines[-1]):
            lines.append(line)
    while lines and not lines[-1]:
        lines.pop()
    return lines


def test_listing_to_texts(spark, tmp_path):
    """Against a walk over the listing, entry by entry."""
    listed = {"BILLS-119hr1ih": "2025-01-10", "BILLS-119hr1eh1s": "2025-01-12", "BILLS-119hr2ih": "2025-01-11", "BILLS-119hr3ih": "2025-01-13", "BILLS-119s1is": "2025-01-05", "BILLS-119s2is": "2025-01-20", "BILLS-119s3is": "2025-01-21", "BILLS-119hr9ih": "2025-01-01", "BILLS-119s4is": None}
    bodies = {"BILLS-119hr1ih.htm": "<html><head><title>t</title></head><pre>\n12\nSEC. 1\n  a   b\n\n\nPage 1\nc &amp; d</pre>", "BILLS-119hr1ih.xml": "<x>not this</x>", "BILLS-119hr1eh1s.xml": "<bill><p>only xml</p></bill>", "BILLS-119hr2ih.htm": "<p>held</p>", "BILLS-119s1is.htm": "<p>first</p><p>second</p>", "BILLS-119s2is.htm": "<p> 7 </p>", "BILLS-119hr9ih.htm": "<p>behind the frontier</p>", "BILLS-119s4is.htm": "<p>undated</p>", "BILLS-119zz.htm": "<p>not listed</p>"}
    (tmp_path / "bodies").mkdir()
    for name, text in bodies.items():
        (tmp_path / "bodies" / name).write_text(text)
    listing = spark.createDataFrame([(p, t and datetime.fromisoformat(t + "T00:00:00+00:00"), p + ".xml") for p, t in listed.items()], "package string, last_modified timestamp, name string")
    listing = listing.withColumn("bill_id", F.regexp_replace("package", r"^BILLS-(\d+)([a-z]+)(\d+).*", "$1:$2:$3")).withColumn("version_code", F.regexp_extract("package", r"^BILLS-\d+[a-z]+\d+(.*)$", 1))
    held = spark.createDataFrame([("119:hr:2", "ih")], "bill_id string, version_code string")
    frontier = spark.createDataFrame([("119:hr", datetime(2025, 1, 1, tzinfo=UTC)), ("118:hr", datetime(2024, 1, 1, tzinfo=UTC))], "slot string, last_modified timestamp")
    found, ends = readers.listed_texts(listing, f"file://{tmp_path}/bodies", held, frontier, F.lit(DAY))
    want, seen = {}, {"119:hr": "2025-01-01", "118:hr": "2024-01-01"}
    for p, t in sorted(listed.items(), key=lambda x: x[1] or ""):
        slot = "119:hr" if "hr" in p else "119:s"
        if slot == "119:hr" and (t or "") <= "2025-01-01":
            continue
        seen[slot] = max(seen.get(slot, ""), t or "")
        name = next((p + e for e in (".htm", ".xml") if p + e in bodies), None)
        lines = plain_lines(bodies[name]) if name and p != "BILLS-119hr2ih" else []
        if lines:
            want[p] = ("\n".join(lines) + "\n", len(lines), name)
    got = {r.package: (r.body, r.line_count, r.source_url.rsplit("/", 1)[1]) for r in found.collect()}
    assert got == want and len(want) == 4
    r = {x.package: x for x in found.collect()}["BILLS-119hr1eh1s"]
    assert (r.bill_id, r.version_code, r.version_label, r.sha256) == ("119:hr:1", "eh1s", "Engrossed (House) Amendment (Senate)", hashlib.sha256(b"only xml\n").hexdigest())
    assert {x.slot: str(x.last_modified.date()) for x in ends.collect()} == seen
    again, same = readers.listed_texts(listing, f"file://{tmp_path}/bodies", found, ends)
    assert again.count() == 0 and {x.slot: str(x.last_modified.date()) for x in same.collect()} == seen
