"""Line dedup: Bloom filters of once-seen and twice-seen line hashes pick suspects; only those shuffle.

While one filter of all lines may be broadcast, tasks fill filters of their own, these are merged, and texts meet the merged
one where they are read. Of more lines the filters are cut by hash: a task tells each hash once or twice, these meet by
range, and each range has two filters of bounded size.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, documents, prefix, sized, stored

#: Bits of the largest filter that is broadcast (32 MB, for 2^25 lines), and of a task's and a range's filters beyond that;
#: hashes of a range.
MOST_BITS, RANGE_BITS, RANGE = 28, 25, 1 << 22
SEGMENTS = 64
HASHES = 4
#: Pairs of document and line that may be broadcast; more go through a shuffle join.
MOST_PAIRS = 500_000


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """HASHES bit numbers for each hash."""
    h = hashes.view(np.uint64)
    a, b = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return (a[:, None] + np.arange(HASHES, dtype=np.uint64) * b[:, None]) & np.uint64((1 << bits) - 1)


def _put(filter_: np.ndarray, places: np.ndarray) -> None:
    p = places.ravel()
    np.bitwise_or.at(filter_, (p >> np.uint64(3)).astype(np.int64), np.left_shift(1, (p & np.uint64(7)).astype(np.int64)).astype(np.uint8))


def _has(filter_: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((filter_[(places >> np.uint64(3)).astype(np.int64)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def twice_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """The bits of a Bloom filter that holds each value of the one column of hashes that occurs twice or more.

    Each task fills two filters, once and twice seen; their segments meet by number, where
    twice = twice | twice' | (once & once') and once = once | once'. Only the twice-seen filter goes to the driver.
    """
    size = (1 << bits) // 8

    def fill(batches):
        once, twice, some = np.zeros(size, np.uint8), np.zeros(size, np.uint8), False
        for batch in batches:
            h, n = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_counts=True)
            if len(h):
                some, places = True, _places(h, bits)
                _put(twice, places[_has(once, places) | (n > 1)])
                _put(once, places)
        step = size // SEGMENTS
        for k in range(SEGMENTS if some else 0):
            o, t = (zlib.compress(x[k * step : (k + 1) * step].tobytes(), 1) for x in (once, twice))
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([o], pa.binary()), pa.array([t], pa.binary())], ["k", "once", "twice"])

    def merge(batches):
        at, once, twice = None, None, None
        for batch in batches:
            for k, o, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                o, t = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (o, t))
                if k != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], ["k", "twice"])
                    at, once, twice = k, o.copy(), t.copy()
                else:
                    twice |= t | (once & o)
                    once |= o
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], ["k", "twice"])

    parts = hashes.mapInArrow(fill, "k long, once binary, twice binary")
    merged = parts.repartition(SEGMENTS // 2, "k").sortWithinPartitions("k").mapInArrow(merge, "k long, twice binary")
    out = np.zeros(size, np.uint8)
    for k, t in merged.toLocalIterator():  # SEGMENTS rows
        out[k * (size // SEGMENTS) : (k + 1) * (size // SEGMENTS)] = np.frombuffer(zlib.decompress(bytes(t)), np.uint8)
    return out


def range_suspects(keys: DataFrame, n: int) -> DataFrame:
    """(doc, h, key): the rows of keys (doc, h, key: two longs of a digest) whose h occurs twice or more, and a few others.

    What a task has met before is told by its own filters. Of each hash its first row and the first repeated one go to
    the hash's range, so however frequent a hash is no range has more than two rows of it per task; further ones are
    suspects at once. A range fills its two filters from the rows it gets, and these are suspects if the twice-seen one has
    them.
    """
    names, kinds = ["to", "doc", "h", "key", "twice"], "to long, doc long, h long, key long, twice boolean"
    parts = max(2, -(-n // RANGE))

    def batch(b, to, twice, rows):
        return pa.RecordBatch.from_arrays([pa.array(to[rows]), *[b.column(c).take(pa.array(rows)) for c in names[1:4]], pa.array(twice[rows])], names)

    def meet(batches):
        once, again = (np.zeros((1 << RANGE_BITS) // 8, np.uint8) for _ in range(2))
        for b in batches:
            if not b.num_rows:
                continue
            h, first, inverse, n = np.unique(b.column("h").to_numpy(zero_copy_only=False), return_index=True, return_inverse=True, return_counts=True)
            places = _places(h, RANGE_BITS)
            known = _has(once, places)
            repeated = known | (n > 1)
            tells = ~known | ~_has(again, places)  # that there is such a hash, or that it occurs again
            _put(once, places)
            _put(again, places[repeated])
            to, travels = np.full(b.num_rows, -1), first[tells]
            to[travels] = ((h.view(np.uint64) >> np.uint64(24)) % np.uint64(parts)).astype(np.int64)[tells]
            twice = repeated[inverse]
            yield batch(b, to, twice, np.flatnonzero(twice | (to >= 0)))

    def probe(batches):
        once, again, held = np.zeros((1 << RANGE_BITS) // 8, np.uint8), np.zeros((1 << RANGE_BITS) // 8, np.uint8), []
        for b in batches:
            if b.num_rows:
                h, inverse, n = np.unique(b.column("h").to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
                places = _places(h, RANGE_BITS)
                told = np.bincount(inverse, b.column("twice").to_numpy(zero_copy_only=False)) > 0
                _put(again, places[_has(once, places) | (n > 1) | told])
                _put(once, places)
                held.append(b)
        for b in held:
            mask = _has(again, _places(b.column("h").to_numpy(zero_copy_only=False), RANGE_BITS))
            if mask.any():
                yield b.filter(pa.array(mask))

    met = stored(keys.select(F.lit(-1).cast("long").alias("to"), F.col("doc").cast("long"), "h", "key").mapInArrow(meet, kinds), "met-lines")
    probed = met.filter("to >= 0").repartition(parts, "to").mapInArrow(probe, kinds)
    return met.filter("twice AND to < 0").union(probed).select("doc", "h", "key")


def repeated_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, id_col: str = "doc_id", text: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """(doc, h): for each document the hashes of the line keys that it loses. A stored table.

    A key is lost if least_docs documents or more hold it, except in the largest id. Rows with one id are one document; a
    null id is one too, smaller than all others. Null texts are empty; extra columns aren't read. Of more lines than a
    filter of most_bits holds at eight bits each, keys are told apart by a digest of 128 bits and not by their text.
    """
    spark = docs.sparkSession
    whole = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    n = whole.agg(F.sum(F.regexp_count("t", F.lit("\n")) + 1)).first()[0] or 0
    lines = whole.select("doc", F.explode(F.split("t", "\n")).alias("line")).select("doc", F.btrim("line", F.lit(BLANKS)).alias("line"))
    keys = lines.filter(F.length("line") >= least_chars).select("doc", ascii_lower(F.col("line")).alias("key")).withColumn("h", F.xxhash64("key"))
    if 8 * n > 1 << most_bits:
        found = range_suspects(keys.select("doc", "h", F.xxhash64(F.lit(1), F.col("key")).alias("key")), n)
        alike = ["key", "h"]
    else:
        bits = max(13, int(8 * n).bit_length())
        bloom = spark.sparkContext.broadcast(twice_filter(keys.select("h"), bits))

        def suspects(batches):
            for batch in batches:
                if batch.num_rows:
                    mask = _has(bloom.value, _places(batch.column("h").to_numpy(zero_copy_only=False), bits))
                    if mask.any():
                        yield batch.filter(pa.array(mask))

        found, alike = keys.mapInArrow(suspects, keys.schema), ["key"]
    pairs = stored(found.groupBy(*alike, "doc").agg(F.first("h").alias("h1")), "suspects")
    holders = pairs.groupBy(*alike).agg(F.count("*").alias("n"), F.max("doc").alias("keeper")).filter(F.col("n") >= least_docs)
    lost = pairs.join(sized(stored(holders.select(*alike, "keeper"), "holders"), 100_000), alike).filter(~F.col("doc").eqNullSafe(F.col("keeper")))
    return stored(lost.select("doc", F.col("h1").alias("h")), "lost-lines")


def with_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, id_col: str = "doc_id", text: str = "text", most_pairs: int = MOST_PAIRS, most_bits: int = MOST_BITS) -> DataFrame:
    """docs, with the text less the lines that other documents keep, and n_lines and n_dropped, named with common.prefix(docs).

    A text that loses no line stays as it is, null ones too; one that loses all becomes empty. Repeated rows each lose the
    same lines; extra columns pass through, whatever their names. While at most most_pairs pairs of document and line are
    lost they are broadcast, and texts don't shuffle; more are joined by a shuffle.
    """
    pre = prefix(docs)
    c = lambda name: F.col(pre + name)
    lost = repeated_lines(docs, least_chars, least_docs, id_col, text, most_bits)
    few = lost.count() <= most_pairs
    lost = lost.groupBy(F.col("doc").alias(pre + "doc")).agg(F.collect_set("h").alias(pre + "lost"))
    df = docs.join(F.broadcast(lost) if few else lost, docs[id_col].eqNullSafe(c("doc")), "left")
    df = df.withColumn(pre + "lines", F.split(F.coalesce(docs[text], F.lit("")), "\n"))
    gone = lambda x: (F.length(F.btrim(x, F.lit(BLANKS))) >= least_chars) & F.array_contains(c("lost"), F.xxhash64(line_key(x)))
    df = df.withColumn(pre + "kept", F.when(c("lost").isNotNull(), F.filter(c("lines"), lambda x: ~gone(x))))
    cols = [F.when(c("lost").isNotNull(), F.array_join(c("kept"), "\n")).otherwise(docs[text]).alias(text) if x == text else docs[x] for x in docs.columns]
    n = F.size(c("lines")).cast("long")
    return df.select(*cols, n.alias(pre + "n_lines"), F.coalesce(n - F.size(c("kept")), F.lit(0)).cast("long").alias(pre + "n_dropped"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return df.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH l AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
h AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, h.keeper IS NOT NULL AND l.doc_id <> h.keeper AS gone FROM l LEFT JOIN h USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
