"""Filter interaction audit: what each filter removes in every order, from one count for each set of failed filters."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, documents, stored

#: Name and condition of failure; n_words and n_distinct are counted beside the text. Names are one character.
TESTS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "A": lambda text, n_words, n_distinct: n_words < 50,
    "B": lambda text, n_words, n_distinct: n_distinct * 100 < n_words * 65,
    "C": lambda text, n_words, n_distinct: F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 5,
    "D": lambda text, n_words, n_distinct: text.rlike("[#$%&*|]"),
}
DUPLICATE = "E"
KINDS = ("n", "good", "toxic")


def mask_counts(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", part: str = "source", tests: dict | None = None) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail just the filters in mask (bit k is the k-th test, the last bit is the duplicates'), and how many of these are labelled.

    A document is a duplicate if a smaller id has the same text, so of each text all rows with its least id aren't. Texts
    are compared by digests of 256 bits. The least id of a text is a partial aggregate, and rows meet it by (digest, id), so
    a group of copies lies in no one task. An id with several labels is good or toxic if one of them says so.
    """
    tests = TESTS if tests is None else tests
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("body"))
    rows = rows.withColumn("words", F.regexp_extract_all("body", F.lit(f"({WORD})"), F.lit(1)))
    rows = rows.withColumns({"n_words": F.size("words"), "n_distinct": F.size(F.array_distinct("words")), "digest": F.unhex(F.sha2(F.col("body").cast("binary"), 256))})
    mask = sum((F.when(f(F.col("body"), F.col("n_words"), F.col("n_distinct")), 1 << k).otherwise(0) for k, f in enumerate(tests.values())), F.lit(0))
    rows = stored(rows.select("id", "part", "digest", mask.alias("mask")), "failures")
    least = rows.groupBy("digest").agg(F.min("id").alias("least")).withColumnRenamed("digest", "of")
    rows = rows.join(least, (F.col("digest") == F.col("of")) & F.col("id").eqNullSafe(F.col("least")), "left")
    rows = stored(rows.select("id", "part", (F.col("mask") + F.when(F.col("of").isNull(), 1 << len(tests)).otherwise(0)).alias("mask")), "masks")
    marks = labels.groupBy(F.col("doc_id").alias("of")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    marked = rows.join(marks.filter("good = 1 or toxic = 1"), F.col("id") == F.col("of")).groupBy("part", "mask")
    zero = F.lit(0).cast("long")
    counts = rows.groupBy("part", "mask").agg(F.count("*").alias("n")).select("part", "mask", "n", zero.alias("good"), zero.alias("toxic"))
    counts = counts.unionByName(marked.agg(F.coalesce(F.sum("good"), zero).alias("good"), F.coalesce(F.sum("toxic"), zero).alias("toxic")).withColumn("n", zero))
    return counts.groupBy("part", "mask").agg(*[F.sum(k).alias(k) for k in KINDS])


def _over_sets(values: Column, n: int, supersets: bool) -> Column:
    """values, one for each set of n things by its bits, summed for each set over its supersets or its subsets."""

    def total(t: Column) -> Column:
        among = F.transform(values, lambda v, s: F.when(s.bitwiseAND(t) == (t if supersets else s), v).otherwise(0))
        return F.aggregate(among, F.lit(0).cast("long"), lambda a, v: a + v)

    return F.transform(F.sequence(F.lit(0), F.lit((1 << n) - 1)), total)


def polynomials(counts: DataFrame, n: int) -> DataFrame:
    """For each part and each kind of count: total, and the coefficients of the removal polynomial by set of variables.

    With filter i applied with chance x_i, a document that fails the filters in m is removed with chance
    1 - product over i in m of (1 - x_i). Multiplied out and summed, the term of the set t has the coefficient
    (-1)^(|t|+1) times the documents that fail all of t.
    """
    each = {k: F.array(*[F.sum(F.when(F.col("mask") == m, F.col(k)).otherwise(0)) for m in range(1 << n)]) for k in KINDS}
    rows = counts.groupBy("part").agg(F.sum("n").alias("total"), *[c.alias(k) for k, c in each.items()])
    for k in KINDS:
        rows = rows.withColumn(k, _over_sets(F.col(k), n, supersets=True))
        rows = rows.withColumn(k, F.transform(k, lambda v, t: F.when(t == 0, F.lit(0)).when(F.bit_count(t) % 2 == 1, v).otherwise(-v).cast("long")))
    return rows


def shares(n: int) -> list[int]:
    """n! times the integral over 0..1 of what a term with d variables gives to one variable's derivative along the diagonal, which is t^(d-1): whole numbers, as d divides n!."""
    exact = [Fraction(factorial(n)) * Fraction(1, d) for d in range(1, n + 1)]
    assert all(x.denominator == 1 for x in exact)
    return [0, *map(int, exact)]


def audited(counts: DataFrame, names: str, orders: list[str] | None = None) -> DataFrame:
    """A row for each part, order of the filters (all, or those given) and step, from mask_counts. names: a character for each bit.

    Corners of the polynomial, where each filter is on or off, are what a set of filters removes: kept, removed, redundant
    and unique_fails are differences of corners; good_lost and toxic_lost are those of the labelled documents' polynomials.
    shapley is the integral of the filter's partial derivative along the diagonal, times n!: what it removes summed over
    all orders, exact. A part costs 3 * 2^n numbers and 3 * 4^n sums, so n is a handful; all orders are n! strings.
    """
    n, full = len(names), (1 << len(names)) - 1
    rows = polynomials(counts, n)
    weights = F.array(*[F.lit(x).cast("long") for x in shares(n)])

    def shapley(i: int) -> Column:
        given = F.transform("n", lambda v, t: F.when(t.bitwiseAND(1 << i) != 0, v * F.get(weights, F.bit_count(t))).otherwise(0))
        return F.aggregate(given, F.lit(0).cast("long"), lambda a, v: a + v)

    rows = rows.withColumn("shapley", F.array(*[shapley(i) for i in range(n)]))
    for k in KINDS:
        rows = rows.withColumn(k, _over_sets(F.col(k), n, supersets=False))  # now the corners
    orders = ["".join(p) for p in permutations(names)] if orders is None else orders
    rows = rows.withColumn("filter_order", F.explode(F.split(F.lit("\n".join(orders)), "\n")))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.length("filter_order"))))
    upto = lambda k: F.substring("filter_order", F.lit(1), k)
    on = lambda some: sum((F.when(F.instr(some, c) > 0, 1 << i).otherwise(0) for i, c in enumerate(names)), F.lit(0))
    own = F.substring("filter_order", F.col("step"), F.lit(1))
    rows = rows.withColumns({"before": on(upto(F.col("step") - 1)), "after": on(upto(F.col("step"))), "bit": on(own)})
    at = lambda k, s: F.get(F.col(k), s)
    lost = lambda k: at(k, F.col("after")) - at(k, F.col("before"))
    return rows.select(
        "part", "filter_order", "step", (F.col("total") - at("n", F.col("after"))).alias("kept"), lost("n").alias("removed"), (at("n", F.col("bit")) - lost("n")).alias("redundant"),
        (at("n", F.lit(full)) - at("n", F.lit(full) - F.col("bit"))).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
        F.get("shapley", F.log2("bit").cast("int")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", part: str = "source", tests: dict | None = None, orders: list[str] | None = None) -> DataFrame:
    """The audit of tests (name and condition) and of the duplicates' filter over docs, by part.

    A null text is empty; a null part is the empty string's; a null id is greater than all others (so of copies without any
    id none is a duplicate) and has no label; rows that repeat an id and text are documents of their own and no duplicates
    of one another; further columns are not read; without documents there are no parts and no rows; labels may be empty.
    """
    tests = TESTS if tests is None else tests
    return audited(mask_counts(docs, labels, text, id, part, tests), "".join(tests) + DUPLICATE, orders)


def op13_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (SELECT doc_id, part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b, 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) AS c,
        regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT x1.c || x2.c || x3.c || x4.c || x5.c AS filter_order FROM x x1, x x2, x x3, x x4, x x5 WHERE len(list_distinct([x1.c, x2.c, x3.c, x4.c, x5.c])) = 5),
s AS (SELECT filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS c, string_split(substr(filter_order, 1, step::INT - 1), '') AS earlier FROM o, range(1, 6) r(step)),
k AS (SELECT part, filter_order, step, n, good, toxic, fails[c] AS fail, len(list_filter(earlier, lambda y: y <> '' AND fails[y])) > 0 AS gone,
        len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda y: fails[y])) AS n_fails FROM m, s)
SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT gone AND NOT fail), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND fail), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (gone AND fail), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fail AND n_fails = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (NOT gone AND fail), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fail), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(n_fails, 1)) FILTER (fail), 0)::BIGINT AS shapley FROM k GROUP BY part, filter_order, step"""
