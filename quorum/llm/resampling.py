"""Importance resampling towards a target: hashed word features, a gain for each bucket, and the documents with the highest noisy scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, documents, prefix, stored

#: After A-Z are lower-cased, words are runs of digits, a-z and all that isn't ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
#: Gains and noise are whole thousandths of natural logarithms.
SCALE = 1000


def with_buckets(df: DataFrame, text: str, name: str, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """df, and as name_w the words of text, as name the bucket (CRC-32 of the bytes, modulo buckets) of each run of 1 to longest words, joined by a blank; empty lists for a null."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text), F.lit(""))), F.lit(f"({WORD})"), F.lit(1))
    df, words = df.withColumn(f"{name}_w", words), F.col(f"{name}_w")  # a column of its own, so it isn't made anew for each run

    def of(feature: Column) -> Column:
        return (F.crc32(feature.cast("binary")) % buckets).cast("int")

    def runs(k: int) -> Column:
        at = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: of(F.array_join(F.slice(words, i, F.lit(k)), " ")))

    singles = F.transform(words, of)
    return df.withColumn(name, F.concat(singles, *[runs(k) for k in range(2, longest + 1)]) if longest > 1 else singles)


def bucket_counts(features: DataFrame, column: str, buckets: int = BUCKETS) -> list[int]:
    """How often each bucket occurs in a column of lists; the driver gets a row for each bucket, whatever the table's size."""
    counts = [0] * buckets
    for b, n in features.select(F.explode(column).alias("b")).groupBy("b").agg(F.count("*")).collect():
        counts[b] = n
    return counts


def gains(source: list[int], target: list[int]) -> list[int]:
    """For each bucket the logarithm of its smoothed share in the target over that in the source, in whole 1/SCALE, floors down."""
    n, s, t = len(source), sum(source), sum(target)
    return [math.floor(SCALE * math.log(float(b + 1) * float(s + n) / (float(a + 1) * float(t + n)))) for a, b in zip(source, target, strict=True)]


def noise(id: Column, seed: str) -> Column:
    """A Gumbel variable of an id, the same in every run; a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -float(SCALE)).cast("long")


def scored(docs: DataFrame, target: DataFrame, text: str = "text", id: str = "doc_id", target_text: str = "text", longest: int = 1, buckets: int = BUCKETS, seed: str = "2024", keep: list[str] | None = None, pre: str | None = None) -> DataFrame:
    """The columns keep of docs (all), and with the prefix pre (or common.prefix(docs) and r_): n_words, n_features, weight, score.

    Whole texts are read once: their buckets are stored, counted, and scored by a look-up in the list of gains, which has a
    number for each bucket.
    """
    spark, pre = docs.sparkSession, pre or prefix(docs) + "r_"
    keep = docs.columns if keep is None else keep
    rows = with_buckets(docs, text, pre + "b", longest, buckets)
    rows = stored(rows.select(*keep, F.col(id).alias(pre + "id"), F.size(pre + "b_w").cast("long").alias(pre + "n_words"), F.size(pre + "b").cast("long").alias(pre + "n_features"), pre + "b"), "buckets")
    wanted = with_buckets(target.select(target_text), target_text, "b", longest, buckets)
    gain = gains(bucket_counts(rows, pre + "b", buckets), bucket_counts(wanted, "b", buckets))
    table = F.split(F.lit(" ".join(map(str, gain))), " ").cast("array<bigint>")  # folded into one constant
    weight = F.aggregate(pre + "b", F.lit(0).cast("long"), lambda total, b: total + F.get(table, b))
    rows = rows.withColumn(pre + "weight", weight)
    return rows.select(*keep, pre + "id", pre + "n_words", pre + "n_features", pre + "weight", (F.col(pre + "weight") + noise(F.col(pre + "id"), seed)).alias(pre + "score"))


def ranked(rows: DataFrame, score: str, id: str, eligible: Column, percent: int, rank: str) -> DataFrame:
    """rows, a stored table, and the column rank: 1, 2, ... for the floor(percent * n / 100) highest scores of the n eligible rows, ties by id, a null one last; null for all others.

    Scores are whole numbers: their exact histogram is dealt by ranges of scores, the partitions' sums are added up from
    the highest, and within each partition the counts above each score. So each score has the rank where it starts; scores
    that start within the draw survive, and only their rows are shuffled, by score, and numbered by id within it. The noise
    spreads rows of one weight over so many scores that none holds more than a 2,700th of them; only rows that repeat one id
    and text share a score, and these are numbered in any order.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hist = rows.filter(eligible).groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n"))
    hist = stored(hist.repartitionByRange(parts, "score").withColumn("part", F.spark_partition_id()), "scores")
    above, total = {}, 0
    for part, n, _ in sorted(hist.groupBy("part").agg(F.sum("n"), F.max("score")).collect(), key=lambda r: -r[2]):  # a row for each partition
        above[part], total = total, total + n
    draw = total * percent // 100
    if not draw:
        return rows.withColumn(rank, F.lit(None).cast("long"))
    above = F.broadcast(spark.createDataFrame(list(above.items()), "part int, above long"))
    before = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    starts = hist.join(above, "part").select("score", (F.col("above") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("start"))
    starts = stored(starts.filter(F.col("start") < draw), "starts")
    cutoff = starts.agg(F.min("score")).first()[0]
    survives = F.coalesce(eligible & (F.col(score) >= cutoff), F.lit(False))
    names = prefix(rows)
    starts = starts.select(F.col("score").alias(names + "s"), F.col("start").alias(names + "start"))
    within = Window.partitionBy(names + "s").orderBy(F.col(id).asc_nulls_last())
    place = F.col(names + "start") + F.row_number().over(within)
    best = rows.filter(survives).join(starts, F.col(score) == F.col(names + "s")).withColumn(names + "place", place)
    best = best.select(*rows.columns, F.when(F.col(names + "place") <= draw, F.col(names + "place")).cast("long").alias(rank))
    return best.unionByName(rows.filter(~survives).withColumn(rank, F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, text: str = "text", id: str = "doc_id", target_text: str = "text", longest: int = 1, buckets: int = BUCKETS, least_words: int = 20, percent: int = 10, seed: str = "2024", keep: list[str] | None = None, pre: str | None = None) -> DataFrame:
    """The columns keep of docs (all), and with the prefix pre (or common.prefix(docs) and r_): n_words, n_features, weight, score, rank.

    Of the documents with least_words words, percent of a hundred are drawn without putting back, each with odds by its
    weight: those with the highest scores, the weight and a Gumbel variable of the id. A null or empty text has no features,
    weight 0, and is drawn only if least_words is 0. A null id counts as an empty one and comes last among ties; repeated
    rows are documents of their own with the same score. Empty tables give no rows, or weights against an empty target;
    further columns pass through, whatever their names.
    """
    pre = pre or prefix(docs) + "r_"
    keep = docs.columns if keep is None else keep
    rows = stored(scored(docs, target, text, id, target_text, longest, buckets, seed, keep, pre), "scored")
    out = ranked(rows, pre + "score", pre + "id", F.col(pre + "n_words") >= least_words, percent, pre + "rank")
    return out.drop(pre + "id")


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of docs, with the columns of docs."""
    pre = prefix(docs) + "r_"
    return resampled(docs, target, pre=pre, **options).filter(F.col(pre + "rank").isNotNull()).select(*docs.columns)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    rows = resampled(docs, target, keep=["doc_id"], pre="__r_")
    return rows.select("doc_id", *[F.col("__r_" + c).alias(c) for c in ("n_features", "weight", "score", "rank")])


OP11_SQL = r"""
WITH RECURSIVE step(i, k, c) AS (
  SELECT i, 0, i::UBIGINT FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM step WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM d) GROUP BY word),
gw AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM g) GROUP BY word),
hexed AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM gw)),
crc AS (SELECT word, (xor(list_reduce(list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::UBIGINT),
          lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::INT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) % 10000)::INT AS b FROM hexed, tab),
cnt AS (SELECT b, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM (
          SELECT b, n AS s, 0 AS t FROM dw JOIN crc USING (word) UNION ALL SELECT b, 0, n FROM gw JOIN crc USING (word) UNION ALL SELECT b, 0, 0 FROM range(10000) r(b)) GROUP BY b),
tot AS (SELECT sum(s) AS s, sum(t) AS t FROM cnt),
gain AS (SELECT b, floor(1000 * ln((cnt.t + 1) * (tot.s + 10000) / ((cnt.s + 1) * (tot.t + 10000))))::BIGINT AS gain FROM cnt, tot),
wt AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM (SELECT doc_id, unnest(w) AS word FROM d) JOIN crc USING (word) JOIN gain USING (b) GROUP BY doc_id),
sc AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN wt USING (doc_id)),
rk AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM sc WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM sc LEFT JOIN rk USING (doc_id)"""
