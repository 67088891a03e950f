"""The queries without SQL, at their contracts' parameters, against brute force; the branches for very long texts and words; the work of the similarity join."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from test_operators import reach, sets_of, tokenizer

from quorum.llm import jaccard, words
from quorum.llm.registry import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text or "", r.source) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


def test_op2(spark, docs):
    rows = QUERIES["op2_mix_sources"](spark, DATA)
    assert dict(rows.dtypes).items() >= {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}.items()
    got = {r.doc_id: r for r in rows.collect()}
    size = {i: len(WORD.findall(t)) for i, t, _ in docs}
    by = defaultdict(int)
    for i, _, s in docs:
        by[s] += size[i]
    order = sorted(by, key=lambda s: (s is None, s))
    weight, target, left = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, {}, 1.5 * sum(by.values())
    while True:  # what would be above twice a source's size stays there, the rest is shared anew
        free = [s for s in order if s not in target]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if share[s] > 2 * by[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * by[s]
            left -= target[s]
    taken = defaultdict(int)
    for i, _, s in docs:
        r = got[i]
        assert (r.size, r.source_size) == (size[i], by[s]) and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * size[i]
        taken[s] += r.taken
    assert len(got) == len(docs) and all(abs(taken[s] - target[s]) <= max(size[i] for i, _, x in docs if x == s) for s in by)
    assert {r.doc_id: r.taken for r in QUERIES["op2_mix_sources"](spark, DATA).collect()} == {i: r.taken for i, r in got.items()}


def test_op4(spark, docs):
    rows = QUERIES["op4_best_fit_packing"](spark, DATA)
    types = dict(rows.dtypes)
    assert types["piece"] == "int" and all(types[c] == "bigint" for c in ("doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"))
    pieces, sequences, total = defaultdict(list), defaultdict(list), 0
    for r in rows.collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, text, _ in docs:
        ids = [*tokenizer().encode(text, add_special_tokens=False).ids, 0]
        own, at = sorted(pieces[i], key=lambda r: r.piece), 0
        for k, r in enumerate(own):
            cut = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(cut)) and (k == 0 or r.length == 2048 or k == len(own) - 1)
            at += r.length
        assert at == len(ids) and (len(own) == 1) == (len(ids) <= 2048)
        total += at
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= math.ceil(total / 2048) * 1.02 + 1


def test_op6(spark, docs):
    rows = QUERIES["op6_token_counts"](spark, DATA)
    assert dict(rows.dtypes).items() >= {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}.items()
    count = {i: len(tokenizer().encode(t, add_special_tokens=False).ids) for i, t, _ in docs}
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows.collect()} == {(i, len(t.encode()), count[i], count[i] > 1024) for i, t, _ in docs}


def test_op7(spark, docs):
    rows = QUERIES["op7_lm_scoring"](spark, DATA)
    assert dict(rows.dtypes).items() >= {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"}.items()
    tokens = {i: [*WORD.findall(t.translate(LOWER)), None] for i, t, _ in docs}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    count = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = count.total(), len(count)
    got = {r.doc_id: r for r in rows.collect()}
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) and r.score < 0
    mean = lambda f: sum(f(got[i]) for i in got if held[i]) / sum(len(tokens[i]) for i in got if held[i])
    assert len(got) == len(docs) and mean(lambda r: r.score) > mean(lambda r: r.base_score)  # the model tells held-out text better than counts alone


def test_very_long_texts_and_words():
    rng = random.Random(3)
    long = " ".join(rng.choice(["Ab", "c", "é", "d" * 300, "E" * 1000 + "x", "E" * 1000 + "y", "f\x0bg"]) + str(rng.randrange(9)) for _ in range(9000))
    assert len(long.encode()) > 2 * words.CHUNK
    texts = ["one two", long, None, long.lower(), "a b c d e f", long + " end", ""]
    got = [set(s.tolist()) for s in words.shingle_sets(pa.array(texts))]
    plain = [sets_of(t) for t in texts]
    assert [len(s) for s in got] == [len(s) for s in plain] and got[1] == got[3] and len(got[1] & got[5]) == len(plain[1] & plain[5])
    alone = [set(s.tolist()) for t in texts for s in words.shingle_sets(pa.array([t], pa.string()))]
    assert alone == got  # a text's set doesn't depend on what it is hashed with
    base = "w" * 255
    several = [base, base + "w", base + "ww", base + "w" * 200, base + "w" * 199 + "v", "W" + base[1:], base + "w" * 600, base + "w" * 592 + "vwwwwwww"]
    hashes = [int(words.word_hashes(*words.text_bytes(pa.array(["x " * k + w])))[0][-1]) for k, w in enumerate(several)]
    assert hashes[5] == hashes[0] and len(set(hashes)) == len(several) - 1


def near_threshold(n, seed):
    """Texts that share most of their shingles, each pair of them about as much as links ask for."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(120)]
    out = []
    for i in range(n):
        ws = list(base)
        for p in rng.sample(range(120), rng.choice([2, 2, 3])):
            ws[p] = f"x{i}.{p}"
        out.append(" ".join(ws))
    return out


def test_work_on_a_hot_group(spark, monkeypatch):
    """Of a group of texts about the threshold, most of them just below, the components are exact; a set is compared in full with its nearest first, and not with all others."""
    real, full, n = jaccard.verified, [], 150

    def counted(pairs, *a):
        full.append(pairs.count())
        return real(pairs, *a)

    monkeypatch.setattr(jaccard, "verified", counted)
    texts = near_threshold(n, 5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc: r.component for r in jaccard.similar_components(df).collect()}
    sets = [sets_of(t) for t in texts]
    links = [(i, j) for i in range(n) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert got == reach(range(n), links) and len(links) > n // 2
    assert full[1] <= jaccard.NEAREST * n and sum(full) < 0.4 * n * (n - 1) / 2
