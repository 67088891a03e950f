import html
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quorum.text import clean
from quorum.text.clean import version_changes

ROWS = [("a", k, f"first\nline {k}\nlast") for k in range(40)] + [("b", 1, "only"), ("c", 2, "x"), ("c", 2, "y"), ("c", 1, "z"), ("d", None, "none"), ("d", 5, None), (None, 1, "p"), (None, 2, "q\nr")]


LINE = re.compile(r'<span class="(add|del|same|hunk)">(.*)</span>')


def patched(old, shown):
    """What a shown difference makes of a text: its hunks applied by hand, with the lines that it counts."""
    lines, at, out, count = old.split("\n"), 0, [], defaultdict(int)
    for part in shown.split("\n"):
        kind, text = LINE.fullmatch(part).groups()
        text = html.unescape(text)
        if kind == "hunk":
            start, size = re.match(r"@@ -(\d+)(?:,(\d+))?", text).groups()
            first = int(start) - (size != "0")
            out += lines[at:first]
            at = first
            continue
        count[kind] += 1
        if kind != "add":
            assert lines[at] == text[1:]
            at += 1
        if kind != "del":
            out.append(text[1:])
    return "\n".join(out + lines[at:]), (count["add"], count["del"], count["same"])


def texts_of(rows):
    held = defaultdict(list)
    for k, at, body in rows:
        held[k].append((at is not None, at or 0, body is not None, body or "", at, body))
    return {k: (sorted(v)[-2] if len(v) > 1 else (None, None), sorted(v)[-1]) for k, v in held.items()}


def edited(text, rng):
    lines = text.split("\n")
    for _ in range(rng.randrange(6)):
        i = rng.randrange(len(lines) + 1)
        lines[i : i + rng.randrange(3)] = [f"<new & {rng.randrange(5)}>" for _ in range(rng.randrange(3))]
    return "\n".join(lines)


@pytest.mark.parametrize("kept", [False, True])
def test_last_two_versions(spark, tmp_path, kept):
    rng = random.Random(7)
    long = "\n".join(f"line {k % 9}" for k in range(60))
    rows = ROWS + [(f"e{k}", v, t) for k in range(25) for v, t in enumerate((long, edited(long, rng)))] + [("same", 1, "s\nt"), ("same", 2, "s\nt")]
    found = version_changes(spark.createDataFrame(rows, "k string, at int, body string").repartition(5), "k", "at", "body", f"file://{tmp_path}/kept" if kept else None)
    want = texts_of(rows)
    got = {r.k: r for r in found.collect()}
    assert set(got) == set(want)
    for k, (before, last) in want.items():
        r, old, new = got[k], before[-1] or "", last[-1] or ""
        assert (r["from"], r["to"]) == (before[-2], last[-2])
        if old == new:
            assert (r.added, r.removed, r.unchanged) == (0, 0, 0) and "no difference" in r.html
        else:
            assert patched(old, r.html) == (new, (r.added, r.removed, r.unchanged))
    plan = found._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "WindowGroupLimit" in plan  # no task holds all texts of a key


def test_a_pair_is_compared_once(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(k, v, "a\nb" if v == 1 else "a\nc") for k in "xyz" for v in (1, 2)], "k string, at int, body string")
    first = version_changes(rows, "k", "at", "body", f"file://{tmp_path}/kept").collect()
    monkeypatch.setattr(clean, "diff", lambda *a: F.raise_error(F.lit("computed again")))
    again = version_changes(rows, "k", "at", "body", f"file://{tmp_path}/kept").collect()
    assert sorted(first) == sorted(again) and {(r.added, r.removed, r.unchanged) for r in again} == {(1, 1, 1)}
    assert spark.read.parquet(f"file://{tmp_path}/kept/results/v=1").count() == 1
