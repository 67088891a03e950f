"""What grows with the data: hot keys, many sources, many copies in one text, many tiles, many partitions."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from test_operators import licenses_of, reach, tokenizer

from quorum.llm import embeddings, licenses, mixing, packing, tokencount


def chained_anew(t, size, parts, least_percent):
    """The chains of licenses.chained, each found by solving for all parts that are left."""
    out = []
    while parts:
        best, back = [], []
        for j, (first, _, s, m) in enumerate(parts):
            ways = [(m, -1)]
            for i in range(j):
                both = max(0, parts[i][1] - first)
                if first - parts[i][0] <= 2 * size + licenses.SEGMENT and parts[i][2] < s and both <= licenses.BAND and first - parts[i][1] <= (s - parts[i][2]) * 4 * licenses.SEGMENT:
                    ways.append((best[i] + m - both, i))
            most = max(n for n, _ in ways)
            best.append(most)
            back.append(-1 if most == m else max(i for n, i in ways if n == most))
        top = best.index(max(best))
        if 100 * best[top] < least_percent * size:
            break
        start = top
        while back[start] >= 0:
            start = back[start]
        first, end = parts[start][0], parts[top][1]
        out.append((t, best[top], first, end))
        parts = [p for p in parts if p[1] <= first or p[0] >= end]
    return out


@pytest.mark.parametrize("seed", range(40))
def test_chains(seed):
    rng = random.Random(seed)
    size, parts = 170, []
    for _ in range(rng.randrange(1, 60)):
        first = rng.randrange(1500)
        parts.append((first, first + rng.randrange(16, 40), rng.randrange(6), rng.randrange(16, 33)))
    for c in range(rng.randrange(6)):  # and whole copies, side by side
        parts += [(c * 170 + 32 * s, c * 170 + 32 * s + 32 - rng.randrange(3), s, 28 + rng.randrange(4)) for s in range(6) if rng.random() < 0.9]
    parts = sorted(parts)
    for least in (20, 60, 80):
        assert licenses.chained(3, size, parts, least) == chained_anew(3, size, parts, least)


def test_copies_in_one_text(spark):
    """Each of many copies in one text is found, in time in proportion to them."""
    mit = next(t for t in licenses.templates() if t.kind == "text" and t.license == "MIT")
    ix, took = licenses.Index(licenses.templates()), []
    for n in (100, 800):
        h = licenses.word_hashes(" ".join([mit.text, "and then another one"] * n))
        at, keys = ix.hits(h)
        began = time.monotonic()
        found = licenses.matches(ix, h, at, keys, licenses.BAND, licenses.LEAST_PERCENT)
        took.append(time.monotonic() - began)
        assert Counter(ix.names[t] for t, *_ in found) == {("MIT", "text"): n} and all(m == ix.sizes[t] for t, m, _, _ in found)
    assert took[1] < 24 * took[0] + 1


def test_text_without_hits():
    ix = licenses.Index(licenses.templates())
    h = licenses.word_hashes("nothing of the kind here")
    none = np.zeros(0, np.int64)
    assert licenses.matches(ix, h, none, none, licenses.BAND, licenses.LEAST_PERCENT) == []


@pytest.mark.parametrize("k", [5, 6, 8, 12])
def test_replaced_words(spark, k):
    """Whole licenses of which every k-th word has been replaced, 80 percent or more are left, are all found."""
    known = [t for t in licenses.templates() if t.kind == "text"]
    texts = []
    for t in known:
        ws = t.text.split()
        texts.append(" ".join(f"zq{i}" if i % k == k - 1 else w for i, w in enumerate(ws)))
    for t, f in zip(known, licenses_of(spark, *texts), strict=True):
        size = licenses.word_hashes(t.text).size
        left = sum(licenses.word_hashes(w).size for i, w in enumerate(t.text.split()) if i % k != k - 1)
        if 100 * left >= licenses.LEAST_PERCENT * size:
            assert t.license in {r.license for r in f if r.kind == "text"}, (t.license, k)


def test_long_pre_tokens(spark, monkeypatch):
    """A separator line in every document is in the broadcast by its digest: its rows don't meet at one key."""
    line, other = "=" * 40, "é-" * 3 + "-" * 60
    texts = [f"{line}\n{other} w{i} {line}{'x' * (i % 3)}\n" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept, real = [], tokencount.stored

    def seen(rows, label):
        kept.append((label, real(rows, label)))
        return kept[-1][1]

    monkeypatch.setattr(tokencount, "stored", seen)
    got = {r.doc: r.n_tokens for r in tokencount.token_counts(df, most_kept=40).collect()}
    assert got == {i: len(tokenizer().encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    rare = Counter(x for r in dict(kept)["frequencies"].select("pre").collect() for x in r.pre)
    assert max(map(len, rare), default=0) < 300 and max(rare.values()) <= 1 and len(rare) > 200


@pytest.mark.parametrize("strip, many", [(1, 1), (3, 1), (16, 1), (16, 10_000)])
def test_strips_of_tiles(spark, monkeypatch, strip, many):
    monkeypatch.setattr(embeddings, "STRIP_TILES", strip)
    monkeypatch.setattr(embeddings, "MANY_TILES", many)
    monkeypatch.setattr(embeddings, "PARTITIONS", 5)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 6))
    x = np.concatenate([centres[rng.integers(0, 40, 380)] + rng.normal(size=(380, 6)) * 0.25, np.repeat(centres[:4], 5, axis=0)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec: (r.n_links, r.component) for r in embeddings.near_duplicates(df, block=8).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    labels = reach(range(len(x)), list(zip(*np.nonzero(near), strict=True)))
    assert got == {i: (int(near[i].sum()), labels[i]) for i in range(len(x))}


def test_groups_at_powers_of_two(spark):
    """Numbers of rows begin anew at multiples of 2^33 in each partition; groups are even all the same."""
    rows = [(i, 0, 0, 1 + i % 700) for i in range(8 * 212)]  # sixteen groups of 106
    df = spark.createDataFrame(rows, "doc long, piece int, start long, length long").repartition(211)
    out = packing.packed(df, group=len(rows) // 16).collect()
    per = Counter(r.sequence_id >> 32 for r in out)  # a group's sequences begin with its number
    assert len(out) == len(rows) and sum(sorted(r.length for r in out)) == sum(r[3] for r in rows)
    assert len(per) == 16 and max(per.values()) < 2 * len(rows) / 16


def test_many_sources(spark):
    """Twenty thousand sources: no node of the tree holds those that have nothing left, and quotas come out exactly."""
    n, shards = 20_000, 64
    quotas = spark.range(n).selectExpr("CAST(id AS INT) AS i", "id % 3 AS q")
    got = mixing.shard_quotas(quotas, shards, 5).filter("n > 0").collect()
    given, first = Counter(), {}
    per = Counter()
    for r in sorted(got, key=lambda r: (r.i, r.shard)):
        assert r.first == first.get(r.i, 0)
        first[r.i] = r.first + r.n
        given[r.i] += r.n
        per[r.shard] += r.n
    assert given == {i: i % 3 for i in range(n) if i % 3}
    assert len(per) == shards and max(per.values()) - min(per.values()) <= 1
