from collections import Counter, defaultdict

import pytest
from conftest import DATA, same_rows
from pyspark.sql import functions as F
from test_operators import LINE, prose, reach, sets_of, tokenizer

import corpus_pipeline
from quorum.llm.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    same_rows(QUERIES[name](spark, DATA), duck.sql(ORACLE_SQL[name]))


def test_pipeline(spark, duck):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = corpus_pipeline.stored(docs, name)
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    kept = {r[0] for r in duck.sql(f"SELECT doc_id FROM ({ORACLE_SQL['op1_quality_rules']}) WHERE kept").fetchall()}
    assert ids and ids <= kept
    run = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in run} == ids
    assert corpus_pipeline.run(spark, DATA).count() == len(run)


def test_stages_on_odd_rows(spark):
    """Each stage's rows, by id and text, against plain versions: null and repeated ids, repeated rows, near copies, empty and null texts, extra columns."""
    end = " and so the story of this one ends with the rest."
    base = prose(80, 50) + end
    rows = [(3, base, "a"), (7, base, "a"), (7, prose(70, 51) + end, "b"), (None, base.replace(base.split()[40], "other", 1), "a"), (None, prose(60, 52) + end, None), (None, prose(60, 52) + end, None), (8, prose(50, 53) + end, "b"), (8, prose(50, 53) + end, "b"),
            (9, None, "a"), (10, "", "b"), (11, "too short", "c"), *[(20 + i, f"{prose(40, 60 + i)}\n{LINE}\n{prose(30, 70 + i)}{end}", "ab"[i % 2]) for i in range(4)], (20, f"{prose(40, 90)}\n{LINE}{end}", "c")]
    docs = spark.createDataFrame([(i, t, "en", s, -1, "x") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, __row string").repartition(3)
    seen = lambda df: Counter((r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect())

    stages = dict(corpus_pipeline.STAGES)
    judged = corpus_pipeline.stored(stages["quality_rules"](spark, docs, ""), "judged")
    got = seen(judged)
    assert judged.columns == docs.columns and got == Counter(r for r in rows if r[0] not in (9, 10, 11))

    held = defaultdict(set)
    for (i, t, _), _n in got.items():
        for x in t.split("\n"):
            held[x.strip().lower()].add(-1 if i is None else i)
    drop = lambda i, x: len(x.strip()) >= 20 and len(held[x.strip().lower()]) >= 3 and max(held[x.strip().lower()]) != (-1 if i is None else i)
    want = Counter()
    for (i, t, s), n in got.items():
        want[i, "\n".join(x for x in t.split("\n") if not drop(i, x)), s] += n
    lines = corpus_pipeline.stored(stages["line_dedup"](spark, judged, ""), "lines")
    assert lines.columns == docs.columns and seen(lines) == want and sum(LINE in t for _, t, _ in want) == 2
    assert lines.filter(F.length("text") != F.col("n_chars")).count() == 0

    each = [r for r, n in want.items() for _ in range(n)]
    sets = [sets_of(t) for _, t, _ in each]
    label = reach(range(len(each)), [(i, j) for i in range(len(each)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    groups = defaultdict(list)
    for k in range(len(each)):
        groups[label[k]].append((each[k][0] is None, each[k][0] or 0, k))
    alone = corpus_pipeline.stored(stages["near_duplicates"](spark, lines, ""), "alone")
    assert alone.columns == docs.columns and seen(alone) == Counter(each[min(g)[2]] for g in groups.values())
    assert seen(alone)[7, prose(70, 51) + end, "b"] == 1 and seen(alone)[3, base, "a"] == 1

    mixed = corpus_pipeline.stored(stages["mix"](spark, alone, ""), "mixed")
    assert mixed.columns == docs.columns and set(seen(mixed)) <= set(seen(alone)) and max(seen(mixed).values()) <= 2
    sizes = {s: sum(len(t.split()) for _, t, x in seen(alone) if x == s) for _, _, s in seen(alone)}
    assert sum(n * len(t.split()) for (_, t, _), n in seen(mixed).items()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.15)

    packed = stages["pack"](spark, mixed, "").collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(x for (x, _, _), n in seen(mixed).items() for _ in range(n))
    assert sum(r.length for r in packed) == sum(n * (len(tokenizer().encode(t, add_special_tokens=False).ids) + 1) for (_, t, _), n in seen(mixed).items())
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, "")
        assert none.count() == 0
