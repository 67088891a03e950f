"""Resampling, URL filters and the filters' audit against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from quorum.llm import interplay, resampling, urls
from quorum.llm.common import stored
from quorum.llm.registry import QUERIES

WORDS11 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(["Ä", "b7", "see", "the", "État", "x"]) + str(rng.randrange(50)) for _ in range(n))


def features(text, longest):
    words = WORDS11.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def plain_scores(docs, target, longest, buckets, seed="2024"):
    """(id, n_words, n_features, weight, score) of each row."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text, longest)[1]))
    for text in target:
        t.update(map(bucket, features(text, longest)[1]))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        words, runs = features(text, longest)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in runs)
        out.append((i, len(words), len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


def plain_ranks(rows, least, percent):
    """rows (as above) with their ranks, as a multiset: rows with one id and score take their ranks in any order."""
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    out = Counter((*r[:1], *r[2:], k + 1) if k < len(fit) * percent // 100 else (*r[:1], *r[2:], None) for k, r in enumerate(fit))
    out.update((*r[:1], *r[2:], None) for r in rows if r[1] < least)
    return out


@pytest.mark.parametrize(("longest", "buckets", "percent"), [(1, 10_000, 10), (2, 97, 55), (3, 10_000, 100)])
def test_resampling(spark, longest, buckets, percent):
    docs = [(i, prose(15 + i % 30, i % 40)) for i in range(120)] + [(7, prose(25, 99)), (None, prose(30, 5)), (None, prose(31, 6)), (500, None), (501, ""), (502, "--- !!"), (503, "one"), (504, prose(30_000, 3))]
    docs += [(600, prose(28, 600))] * 5  # repeated rows
    target = [prose(40, 7), None, "", "the the THE État"]
    rows = [(i, t, "x", "y") for i, t in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, __r_b string, score string").repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    out = resampling.resampled(df, goal, longest=longest, buckets=buckets, percent=percent)
    assert out.columns[:4] == df.columns
    pre = out.columns[4][: -len("n_words")]
    got = Counter((r["doc_id"], *[r[pre + c] for c in ("n_features", "weight", "score", "rank")]) for r in out.collect())
    assert got == plain_ranks(plain_scores(docs, target, longest, buckets), 20, percent)
    drawn = resampling.drawn_documents(df, goal, longest=longest, buckets=buckets, percent=percent)
    assert drawn.columns == df.columns and drawn.count() == sum(len(features(t, 1)[0]) >= 20 for _, t in docs) * percent // 100


def test_resampling_without_rows(spark):
    docs = spark.createDataFrame([(1, prose(30, 1)), (2, None)], "doc_id long, text string")
    none = docs.limit(0).select("text")
    assert resampling.resampled(docs.limit(0), none).count() == 0
    rows = resampling.resampled(docs, none, percent=100).collect()
    assert {(r.doc_id, r["__r_rank"]) for r in rows} == {(1, 1), (2, None)}
    assert [r["__r_rank"] for r in resampling.resampled(docs, none, percent=10).collect()] == [None, None]


def test_ranks_of_ties(spark):
    """Scores far apart, negative, and shared by many; more different ones than partitions."""
    rng = random.Random(4)
    rows = [(i, rng.choice([-(10**15), -3, 0, 7, 8, 10**15, rng.randrange(-500, 500)]), i % 5 > 0) for i in range(2000)]
    df = stored(spark.createDataFrame(rows, "id long, s long, fit boolean").repartition(7), "ties")
    got = {r.id: r.rank for r in resampling.ranked(df, "s", "id", F.col("fit"), 37, "rank").collect()}
    order = sorted((r for r in rows if r[2]), key=lambda r: (-r[1], r[0]))
    want = {r[0]: k + 1 for k, r in enumerate(order[: len(order) * 37 // 100])}
    assert got == {i: want.get(i) for i, _, _ in rows}


def test_gains_by_hand():
    assert resampling.gains([0, 0], [0, 0]) == [0, 0]
    assert resampling.gains([3, 0], [0, 0]) == [math.floor(1000 * math.log(5 / 8)), math.floor(1000 * math.log(5 / 2))]


def as_regex(glob):
    out, i = "", 0
    while i < len(glob):
        if glob[i] == "*":
            run = re.match(r"\*+", glob[i:]).end()
            out += "(?:.|\n)*" if run > 1 else "[^/?]*"
            i += run
            continue
        i += glob[i] == "\\" and i + 1 < len(glob)
        out += re.escape(glob[i])
        i += 1
    return re.compile(out)


def test_automaton_against_regexes():
    rng = random.Random(1)
    letters = ["a", "b", "/", "?", ".", "é", "*", "**", "\\*", "\\"]
    globs = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 9))) for _ in range(150)] + ["", "*", "**", "a" * 70, "*" + "ab" * 40 + "**", "\\"]
    texts = ["".join(rng.choice("ab/?.é*\\\n") for _ in range(rng.randrange(0, 12))) for _ in range(400)] + ["", "a" * 70, "a" * 69, "ab" * 41, "x" * 30_000 + "/", "a/" * 5000 + "b"]
    automaton = urls.Automaton(globs)
    assert len(automaton.start) > 5  # words of 64 bits
    rules = [as_regex(g) for g in globs]
    want = [[bool(r.fullmatch(t)) for r in rules] for t in texts]
    data, off = urls.text_bytes(pa.array(texts))
    assert automaton.fits(data, off).tolist() == want
    assert automaton.first(pa.array([*texts, None])).to_pylist() == [next((k for k, x in enumerate(w) if x), None) for w in [*want, want[texts.index("")]]]
    assert sum(map(sum, want)) > 300 and urls.Automaton([]).first(pa.array(["a", None])).to_pylist() == [None, None]


def test_runs_of_state(monkeypatch):
    monkeypatch.setattr(urls, "STATE", 10)
    automaton = urls.Automaton(["a**", "*b", "c"])
    assert automaton.first(pa.array(["ab", "b", "c", "", None, "xxb", "d"] * 9)).to_pylist() == [0, 1, 2, None, None, 1, None] * 9


def test_url_rules(spark):
    cases = [
        ("http://A.NET/x", "a.net", "/x", "net/", "block"), ("https://net/", "net", "/", "net/", "block"), ("https://net", "net", "", None, "allow"), ("https://net?x.net/", "net", "", None, "allow"),
        ("https://m.example.net/en/1?q#f", "m.example.net", "/en/1", "example.net/en/", "allow"), ("https://example.net/en", "example.net", "/en", "net/", "block"), ("https://notexample.net/en/", "notexample.net", "/en/", "net/", "block"),
        ("https://example.com/de/", "example.com", "/de/", "example.com/de/", "block"), ("https://xexample.com/de/", "xexample.com", "/de/", None, "allow"), ("https://a.org/fr/x.net/", "a.org", "/fr/x.net/", "org/fr/", "allow"),
        ("https://a.com/x.net/", "a.com", "/x.net/", None, "allow"), ("https://the-casino.com", "the-casino.com", "", None, "block"), ("https://casino.org/fr/", "casino.org", "/fr/", "org/fr/", "allow"), ("https://a.com/casino", "a.com", "/casino", None, "allow"),
        ("ftp://é.com/Ü#://net/", "é.com", "/Ü", None, "allow"), ("no address", "", "", None, "allow"), ("", "", "", None, "allow"), (None, "", "", None, "allow"), ("://", "", "", None, "allow"), ("a://b.net/c://d.com", "b.net", "/c://d.com", "net/", "block"),
        ("https://a.com/b\nc.zip", "a.com", "/b\nc.zip", None, "block"), ("https://casino.gov/x", "casino.gov", "/x", None, "allow"), ("https://long.net/" + "y" * 100_000, "long.net", "/" + "y" * 100_000, "net/", "block"),
    ]
    rows = [(i, c[0], "e", "f") for i, c in enumerate(cases)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, __u_host string, rule string").repartition(4)
    out = urls.judged(df)
    pre = out.columns[4][: -len("host")]
    got = Counter((r.page_id, r[pre + "host"], r[pre + "path"], r[pre + "rule"], r[pre + "verdict"]) for r in out.collect())
    assert got == Counter({(i, *c[1:]): 2 for i, c in enumerate(cases)}) and out.columns[:4] == df.columns
    kept = urls.allowed_pages(df)
    assert kept.columns == df.columns and kept.count() == 2 * sum(c[4] == "allow" for c in cases)
    assert urls.judged(df.limit(0)).count() == 0
    assert {r[0] for r in urls.judged(df, rules=(), globs=(), default="block", pre="v_").select("v_verdict").collect()} == {"block"}


def test_longest_rule_wins(spark):
    df = spark.createDataFrame([("http://a.b.c/d/e*/",), ("http://a.b.c/d/",), ("http://x.c/d/e*/f",)], "url string")
    rules = [urls.HostRule("allow", "c", "/d/"), urls.HostRule("block", "b.c"), urls.HostRule("block", "c", "/d/e*/")]
    assert [r["__u_rule"] for r in urls.judged(df.coalesce(1), rules=rules).collect()] == ["c/d/e*/", "c/d/", "c/d/e*/"]  # of equal length the first given


def plain_audit(docs, labels, tests, names):
    """docs (id, text, part); a row of numbers for each part, order and step, by applying the filters in each order."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    least = defaultdict(set)
    for i, text, _ in docs:
        if i is not None:
            least[text or ""].add(i)
    each = defaultdict(list)
    for i, text, part in docs:
        own = least[text or ""]
        copy = bool(own) and (i is None or min(own) < i)
        fails = {c for c, f in zip(names, tests, strict=False) if f(text or "")} | ({names[-1]} if copy else set())
        each[part or ""].append((fails, i in good, i in toxic))
    out = {}
    for part, rows in each.items():
        total = Counter()
        for order in permutations(names):
            for c in range(len(names)):
                total[order[c]] += sum(order[c] in f and not f & set(order[:c]) for f, _, _ in rows)
        for order in permutations(names):
            left = rows
            for k, c in enumerate(order):
                gone, left = [r for r in left if c in r[0]], [r for r in left if c not in r[0]]
                failing = [r for r in rows if c in r[0]]
                out[part, "".join(order), k + 1] = (len(left), len(gone), len(failing) - len(gone), sum(f == {c} for f, _, _ in rows), sum(g for _, g, _ in gone), sum(t for _, _, t in gone), total[c])
    return out


COLUMNS13 = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN13 = [
    lambda t: len(WORD.findall(t)) < 50, lambda t: 100 * len(set(WORD.findall(t))) < 65 * len(WORD.findall(t)),
    lambda t: 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), lambda t: re.search(r"[#$%&*|]", t) is not None,
]


def test_audit(spark):
    rng = random.Random(8)
    texts = [prose(rng.choice([10, 49, 50, 80, 300]), k % 25) + rng.choice(["", " #", " A" * 30, " tail"]) for k in range(60)] + [None, "", "x\x00y", "AB", prose(20_000, 2)]
    docs = [(rng.choice([*range(80), None]), rng.choice(texts), rng.choice(["a", "b", None, "", "ü"])) for _ in range(400)]
    docs += [(5, "twice", "a")] * 3 + [(5, "twice", "b"), (6, "twice", "b"), (None, "twice", "c"), (None, "only without an id", "c"), (None, "only without an id", "c")]
    labels = [(rng.choice([*range(90), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(80)]
    df = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, source string, mask string, id int").repartition(6)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = plain_audit(docs, labels, PLAIN13, "ABCDE")
    seen = lambda out: {(r.part, r.filter_order, r.step): tuple(r[c] for c in COLUMNS13) for r in out.collect()}
    out = interplay.audit(df, marks)
    assert seen(out) == want and out.count() == len(want) == 600 * len({p or "" for _, _, p in docs})
    assert seen(interplay.audit(df, marks.limit(0))) == plain_audit(docs, [], PLAIN13, "ABCDE")
    assert interplay.audit(df.limit(0), marks).count() == 0
    few = {"A": interplay.TESTS["A"], "x": lambda text, n, d: text.contains("tail")}
    assert seen(interplay.audit(df, marks, tests=few)) == plain_audit(docs, labels, [PLAIN13[0], lambda t: "tail" in t], "AxE")
    assert interplay.audit(df, marks, tests=few, orders=["ExA"]).count() == 3 * len({p or "" for _, _, p in docs})


def test_shares_are_whole():
    assert interplay.shares(5) == [0, 120, 60, 40, 30, 24] and interplay.shares(3) == [0, 6, 3, 2]


def test_digests_of_queries(spark):
    types = {name: dict(QUERIES[name](spark, DATA).dtypes) for name in ("op11_importance_resampling", "op12_url_filters", "op13_filter_interaction")}
    assert types["op11_importance_resampling"] == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank"], "bigint")
    assert types["op12_url_filters"] == {"page_id": "bigint", **dict.fromkeys(["host", "path", "rule", "verdict", "pattern"], "string")}
    assert types["op13_filter_interaction"] == {"part": "string", "filter_order": "string", "step": "int", **dict.fromkeys(COLUMNS13, "bigint")}
