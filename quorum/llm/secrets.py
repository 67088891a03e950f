"""Secret scans with DataFrame functions only: base kinds by pattern, and weak parts by what stands near them.

A credential often has several parts: an access identifier, a secret, an endpoint. Identifiers and assigned secrets tell by
themselves. A bare key-like string or an address is weak: it is reported only where a part that completes it lies within
reach in the same paragraph, found by an interval join on buckets of the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, stored

#: Code points between a weak part and one that completes it, at most.
REACH = 400


@dataclass(frozen=True)
class Kind:
    """A pattern; the group whose length counts, and the least; for a weak kind the kinds that complete it, and patterns it has to hold."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    completes: tuple[str, ...] = ()
    holds: tuple[str, ...] = ()


# Runs of hexadecimal digits and identifiers are maximal, so their least length can be part of the pattern; that of an
# assigned value can't, as a short one takes up what follows the word.
KINDS = (
    Kind("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Kind("access", r"AKIA[A-Z0-9]{14,}"),
    Kind("hex", r"[0-9a-f]{16,}"),
    Kind("key", r"[A-Za-z0-9+/]{32,}", 0, 32, ("access", "endpoint"), ("[A-Z]", "[a-z]", "[0-9]")),
    Kind("endpoint", r"""[a-z]+://[^\x20\x09-\x0D"'<>]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3}""", 0, 7, ("assign", "access", "key")),
)
BASE = ("assign", "access", "hex")
PARAGRAPH = r"\n[\x20\x09]*\n"


def _matches(text: Column, kind: Kind) -> Column:
    """For each match the code points between it and the one before, its length, and whether it counts."""
    whole, value = (F.regexp_extract_all(text, F.lit(f"({kind.pattern})"), F.lit(g)) for g in (1, 1 + kind.group))
    between = F.split(text, kind.pattern, -1)

    def row(x):
        good = F.length(x["v"]) >= kind.least
        for p in kind.holds:
            good = good & x["w"].rlike(p)
        return F.struct(F.length(x["b"]).alias("gap"), F.length(x["w"]).alias("len"), F.coalesce(good, F.lit(False)).alias("good"))

    rows = F.transform(F.arrays_zip(between.alias("b"), whole.alias("w"), value.alias("v")), row)
    return F.when(text.rlike(kind.pattern), F.filter(rows, lambda x: x["len"].isNotNull()))


def parts(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(row, doc) for each row of docs, and (row, kind, start, end, scope): all parts; start and end in code points, scope a paragraph's number. Stored tables."""
    df = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = df.select("row", "doc", "t", *[_matches(F.col("t"), k).alias(f"k{i}") for i, k in enumerate(kinds)])
    any_weak = F.lit(False)
    for i, k in enumerate(kinds):
        any_weak = any_weak | F.col(f"k{i}").isNotNull() if k.completes else any_weak
    breaks = F.when(any_weak, _matches(F.col("t"), Kind("break", PARAGRAPH)))
    lists = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(f"k{i}").alias("m")) for i in range(len(kinds))], F.struct(F.lit(-1).alias("kind"), breaks.alias("m")))
    held = stored(found.select("row", "doc", F.filter(lists, lambda x: x["m"].isNotNull()).alias("lists")), "matches")
    each = held.select("row", F.explode("lists").alias("l")).select("row", F.col("l.kind").alias("kind"), F.posexplode("l.m").alias("i", "m"))
    order = Window.partitionBy("row", "kind").orderBy("i")
    end = F.sum(F.col("m.gap") + F.col("m.len")).over(order).cast("long")
    each = each.select("row", "kind", end.alias("end"), F.col("m.len").alias("len"), F.col("m.good").alias("good")).filter("good OR kind < 0")
    each = each.select("row", "kind", (F.col("end") - F.col("len")).alias("start"), "end")
    scope = F.sum(F.when(F.col("kind") < 0, 1).otherwise(0)).over(Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return held.select("row", "doc"), stored(each.withColumn("scope", scope).filter("kind >= 0"), "parts")


def linked(found: DataFrame, kinds: tuple[Kind, ...] = KINDS, reach: int = REACH) -> DataFrame:
    """The parts that tell by themselves, and the weak ones that a part within reach completes."""
    number = {k.name: i for i, k in enumerate(kinds)}
    weak = [(i, number[c]) for i, k in enumerate(kinds) for c in k.completes]
    buckets = lambda a, b: F.explode(F.sequence(F.floor(a / reach), F.floor(b / reach))).alias("bucket")
    asks = found.filter(F.col("kind").isin(sorted({i for i, _ in weak})))
    asks = asks.select("*", buckets(F.greatest(F.col("start") - reach, F.lit(0)), F.col("end") + reach)).alias("w")
    gives = found.filter(F.col("kind").isin(sorted({c for _, c in weak})))
    gives = gives.select("*", buckets(F.col("start"), F.col("end"))).alias("c")
    fit = F.lit(False)
    for i, c in weak:
        fit = fit | ((F.col("w.kind") == i) & (F.col("c.kind") == c))
    near = F.greatest(F.col("c.start") - F.col("w.end"), F.col("w.start") - F.col("c.end")) <= reach
    same = (F.col("w.row") == F.col("c.row")) & (F.col("w.scope") == F.col("c.scope")) & (F.col("w.bucket") == F.col("c.bucket"))
    told = asks.join(gives, same & fit & near, "left_semi").drop("bucket").distinct()
    return found.filter(~F.col("kind").isin(sorted({i for i, _ in weak}))).unionByName(told)


def secrets(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, reach: int = REACH, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, spans): one row per row of docs; spans: an array of (start, kind, end), sorted, kind a number of kinds.

    Null and empty texts have none; repeated rows and ids are rows of their own; columns besides the id and the text aren't
    read. Matches of one kind don't overlap and are taken from the left; those of different kinds may.
    """
    rows, found = parts(docs, kinds, id_col, text)
    spans = linked(found, kinds, reach).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return rows.join(spans, "row", "left").select("doc", F.coalesce("spans", none).alias("spans"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = secrets(documents(spark, sf_dir))
    names = F.array(*[F.lit(k.name) for k in KINDS])
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"] < len(BASE))
    count = lambda i: F.size(F.filter("spans", lambda x: x["kind"] == i)).cast("long")
    return df.select(F.col("doc").alias("doc_id"), *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op8_sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    sides, weak = [], []
    for i, k in enumerate((*KINDS, Kind("break", PARAGRAPH))):
        holds = "".join(f" AND regexp_matches(m[i], '{p}')" for p in k.holds)
        sides.append(f"""SELECT doc_id, {i if k.name != "break" else -1} AS kind, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start, length(m[i]) AS len
  FROM (SELECT doc_id, m, s, v, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, {quoted(k.pattern)}) AS m, regexp_split_to_array(t, {quoted(k.pattern)}) AS s,
    regexp_extract_all(t, {quoted(k.pattern)}, {k.group}) AS v FROM d)) WHERE length(v[i]) >= {k.least}{holds}""")
        weak += [f"w.kind = {i} AND c.kind = {[x.name for x in KINDS].index(c)}" for c in k.completes]
    names = "[" + ", ".join(f"'{k.name}'" for k in KINDS) + "]"
    weak_kinds = ", ".join(str(i) for i, k in enumerate(KINDS) if k.completes)
    spans = f"coalesce(string_agg({names}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS MATERIALIZED ({" UNION ALL ".join(sides)}),
q AS MATERIALIZED (SELECT doc_id, kind, start::BIGINT AS start, (start + len)::BIGINT AS stop, (SELECT count(*) FROM p b WHERE b.doc_id = p.doc_id AND b.kind = -1 AND b.start <= p.start) AS scope FROM p WHERE kind >= 0),
r AS (SELECT * FROM q WHERE kind NOT IN ({weak_kinds}) UNION ALL SELECT * FROM q w WHERE kind IN ({weak_kinds}) AND EXISTS
  (SELECT 1 FROM q c WHERE c.doc_id = w.doc_id AND c.scope = w.scope AND greatest(c.start - w.stop, w.start - c.stop) <= {REACH} AND ({" OR ".join(f"({x})" for x in weak)})))
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256({spans} FILTER (kind < 3), '')) AS base_sha256, {spans} FILTER (kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id"""
