"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, documents, prefix

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it on as with was are be this from by or an at not "
    "der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es "
    "le la les et des en du que est dans pour un une par sur au pas qui ne ce "
    "el los las del y se por con para una su al lo como más de "
).split()

SYMBOLS = "[#*$%&|<>]"
#: Capital letters of the Latin-1 range.
CAPITALS = r"[A-ZÀ-ÖØ-Þ]"


@dataclass(frozen=True)
class Rule:
    """Holds if least <= 1000 * part / whole <= most, in whole numbers; a bound of None is none."""

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None

    def holds(self) -> Column:
        part, whole, ok = F.col(self.part) * 1000, F.col(self.whole), F.lit(True)
        if self.least is not None:
            ok = ok & (part >= whole * self.least)
        if self.most is not None:
            ok = ok & (part <= whole * self.most)
        return ok


#: In thousandths. The last two columns are the least and the largest share.
RULES = (
    Rule("word_length", "word_chars", "n_words", 1500, 15000),
    Rule("symbols", "n_symbols", "n_words", None, 250),
    Rule("stop_words", "n_stop_words", "n_words", 5, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 500),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 900),
    Rule("cut_lines", "n_cut_lines", "n_lines", None, 300),
    Rule("capitals", "n_capitals", "word_chars", None, 500),
    Rule("echoes", "n_echoes", "n_words", None, 300),
)

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_bullet_lines", "n_cut_lines", "n_capitals", "n_echoes")


def _window_hashes(w: Column) -> Column:
    """A hash of each run of eight words, in order; w: the words' hashes."""
    return F.transform(F.sequence(F.lit(0), F.size(w) - 8), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(8)]))


def with_metrics(docs: DataFrame, text: str = "text", pre: str | None = None) -> DataFrame:
    """docs and the columns of METRICS, each named with the prefix pre, or else common.prefix(docs) and q_. A null text counts as an empty one.

    Words in repeated windows: windows are sorted by hash and place, so equal ones are neighbours; each covers
    its eight words or as many as there are before the next such window. Two windows of one text count as equal when
    their 64-bit hashes are, which for a text of a million words goes wrong once in 10^7 texts.
    """
    pre = pre or prefix(docs) + "q_"
    c = lambda name: F.col(pre + name)
    blank = F.col(pre + "lines")
    df = docs.withColumn(pre + "t", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn(pre + "words", F.regexp_extract_all(c("t"), F.lit(f"({WORD})"), F.lit(1)))
    df = df.withColumn(pre + "lines", F.filter(F.split(c("t"), "\n"), lambda x: x.rlike(WORD)))
    df = df.withColumns({pre + "n": F.size(c("words")), pre + "wh": F.transform(c("words"), lambda x: F.xxhash64(x))})
    df = df.withColumn(pre + "win", F.when(c("n") > 8, _window_hashes(c("wh"))))
    repeats = c("win").isNotNull() & (F.size(F.array_distinct(c("win"))) < F.size(c("win")))
    df = df.withColumn(pre + "by_hash", F.when(repeats, F.array_sort(F.transform(c("win"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = c("by_hash")
    df = df.withColumn(pre + "at", F.when(s.isNotNull(), F.array_sort(F.transform(F.filter(
        F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), ((x["h"] == F.get(s, k + 1)["h"]) | (x["h"] == F.get(s, k - 1)["h"])).alias("same"))),
        lambda x: x["same"]), lambda x: x["i"]))))
    at = c("at")
    covered = F.aggregate(F.transform(at, lambda i, k: F.least(F.lit(8), F.coalesce(F.get(at, k + 1) - i, F.lit(8)))), F.lit(0), lambda a, x: a + x)
    stop = lambda x: F.rtrim(F.lower(x), F.lit(".,;:!?")).isin(STOP_WORDS)
    number = {
        "n_words": c("n"),
        "word_chars": F.length(F.array_join(c("words"), "")),
        "n_symbols": F.regexp_count(c("t"), F.lit(SYMBOLS)),
        "n_dup_lines": F.size(blank) - F.size(F.array_distinct(blank)),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_stop_words": F.size(F.filter(c("words"), stop)),
        "n_lines": F.size(blank),
        "n_bullet_lines": F.size(F.filter(blank, lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))),
        "n_cut_lines": F.size(F.filter(blank, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09\x0D]*$"))),
        "n_capitals": F.regexp_count(c("t"), F.lit(CAPITALS)),
        "n_echoes": F.size(F.filter(c("wh"), lambda h, i: h == F.get(c("wh"), i - 1))),
    }
    return df.select(*docs.columns, *[v.cast("long").alias(pre + k) for k, v in number.items()])


def judged(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, pre: str | None = None) -> DataFrame:
    """docs, the metrics and the verdicts pre + base_failed, pre + kept, pre + failed (the rules that don't hold).

    Null and empty texts have no words and fail the base rule; ties and repeated rows are judged each by itself, no
    row depends on another; further columns of docs pass through, whatever their names: pre, if not given, is
    common.prefix(docs) and q_.
    """
    pre = pre or prefix(docs) + "q_"
    named = [Rule(r.name, pre + r.part, pre + r.whole, r.least, r.most) for r in rules]
    base = (F.col(pre + "n_words") < 20) | (F.col(pre + "n_repeat_words") * 100 > F.col(pre + "n_words") * 30)
    failed = F.filter(F.array(*[F.when(~r.holds(), r.name) for r in named]), lambda x: x.isNotNull())
    df = with_metrics(docs, text, pre).withColumns({pre + "base_failed": base, pre + "failed": failed})
    return df.withColumn(pre + "kept", ~F.col(pre + "base_failed") & (F.size(pre + "failed") == 0))


def kept_documents(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs whose text holds to the rules, with the columns of docs.

    The row's number keeps the filter above the projection that computes the verdict: pushed below, it would hold a copy
    of each metric for each use.
    """
    pre = prefix(docs) + "q_"
    df = judged(docs, text, rules, pre).withColumn(pre + "row", F.monotonically_increasing_id())
    return df.filter(F.col(pre + "kept") & (F.col(pre + "row") >= 0)).select(*docs.columns)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [*METRICS[:5], "base_failed", "kept", "failed"]
    df = judged(documents(spark, sf_dir).select("doc_id", "text"))
    return df.select("doc_id", *[F.col("__q_" + c).alias(c) for c in cols[:-1]], F.array_join("__q_failed", ",").alias("failed_rules"))


def op1_sql() -> str:
    words = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    checks = []
    for r in RULES:
        no = [f"{r.part} * 1000 < {r.whole} * {r.least}"] * (r.least is not None) + [f"{r.part} * 1000 > {r.whole} * {r.most}"] * (r.most is not None)
        checks.append(f"CASE WHEN {' OR '.join(no)} THEN '{r.name}' END")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
wins AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
reps AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM wins) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM reps) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(list_filter(words, lambda x: rtrim(lower(x), '.,;:!?') IN ({words}))) AS n_stop_words,
        len(lines) AS n_lines, len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*\x{{2022}}]'))) AS n_bullet_lines,
        len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[\x20\x09\x0D]*$'))) AS n_cut_lines,
        len(regexp_extract_all(t, '[A-Z\x{{C0}}-\x{{D6}}\x{{D8}}-\x{{DE}}]')) AS n_capitals,
        len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_echoes
      FROM w LEFT JOIN cov USING (doc_id)),
v AS (SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed, concat_ws(',', {', '.join(checks)}) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM v"""
