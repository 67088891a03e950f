"""Token counts without token ids: pieces per distinct pre-token, joined to each document's pre-token frequencies.

A byte-level BPE never merges across pre-tokens, so a text has as many tokens as its pre-tokens have pieces. The pieces of
each distinct pre-token are counted once. The most frequent of them, a bounded number, are broadcast and summed where the
text is read; all others are joined by a shuffle.
"""

from __future__ import annotations

from collections import Counter
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, most_frequent, stored
from .tokens import SPECIAL, file_tokenizer, vocabulary

#: Pre-tokens that are broadcast, and characters of the longest that are so as text: 300,000 * 24 characters bound the broadcast, longer ones are digests of 16 bytes.
MOST_FREQUENT, MOST_CHARS = 300_000, 24
#: Distinct pre-tokens that a task holds at once.
HELD = 400_000


def _splitter(name: str, folder: str | None):
    """A function from a text to its pre-tokens, and how many special strings it holds."""
    import public_tokenizers
    import regex

    pattern, special = regex.compile(public_tokenizers.PATTERN), regex.compile("|".join(map(regex.escape, SPECIAL)))
    assert vocabulary(name, folder)

    def split(text: str) -> tuple[list[str], int]:
        if "<|" not in text:
            return pattern.findall(text), 0
        parts = special.split(text)
        return [x for part in parts for x in pattern.findall(part)], len(parts) - 1

    return split


def pre_token_pieces(docs: DataFrame, name: str = "byte_bpe_50k.json", folder: str | None = None, text: str = "text") -> DataFrame:
    """(pre, n, pieces): each distinct pre-token of the texts, how often it occurs, and its number of pieces. A stored table."""

    def frequencies(batches):
        split, held = _splitter(name, folder), Counter()

        def told():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["pre", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                held.update(split(t or "")[0])
                if len(held) >= HELD:
                    yield told()
                    held.clear()
        yield told()

    def count(batches):
        tokenizer = file_tokenizer(name, folder)
        for b in batches:
            found = tokenizer.encode_batch(b.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in found], pa.int64())], ["pre", "n", "pieces"])

    met = docs.select(F.col(text).alias("t")).mapInArrow(frequencies, "pre string, n long").groupBy("pre").agg(F.sum("n").alias("n"))
    return stored(met.mapInArrow(count, "pre string, n long, pieces long"), "pre-tokens")


def token_counts(docs: DataFrame, name: str = "byte_bpe_50k.json", folder: str | None = None, id_col: str = "doc_id", text: str = "text", most_kept: int = MOST_FREQUENT) -> DataFrame:
    """(doc, n_bytes, n_tokens): one row per row of docs, in bytes of UTF-8 and tokens of the tokenizer file.

    Special strings inside texts are one token, as the library takes them by default. Null and empty texts have neither bytes
    nor tokens; repeated rows and ids are rows of their own; extra columns aren't read.
    """
    known = pre_token_pieces(docs, name, folder, text)
    short = F.length("pre") <= MOST_CHARS
    key = F.when(short, F.encode("pre", "UTF-8")).otherwise(F.unhex(F.substring(F.sha2("pre", 256), 1, 32)))
    top = most_frequent(known, "n", most_kept).select(short.alias("short"), key.alias("key"), "pieces").toPandas()
    keys = [bytes(k).decode() if s else bytes(k) for s, k in zip(top["short"], top["key"], strict=True)]
    frequent = docs.sparkSession.sparkContext.broadcast(dict(zip(keys, top["pieces"].tolist(), strict=True)))

    def sums(batches):
        split, pieces = _splitter(name, folder), frequent.value
        for b in batches:
            docs_, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            ids, rows, n_bytes, sums_, pres, ns = [], [], [], [], [], []
            for i, (doc, t) in enumerate(zip(docs_, texts, strict=True)):
                found, total = split(t or "")
                rare = Counter()
                for x in found:
                    n = pieces.get(x)
                    if n is None and len(x) > MOST_CHARS:
                        n = pieces.get(sha256(x.encode()).digest()[:16])
                    if n is None:
                        rare[x] += 1
                    else:
                        total += n
                ids.append(doc)
                rows.append(b.column(2)[i].as_py())
                n_bytes.append(len((t or "").encode()))
                sums_.append(total)
                pres.append(list(rare))
                ns.append(list(rare.values()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(sums_, pa.int64()), pa.array(pres, pa.list_(pa.string())), pa.array(ns, pa.list_(pa.int64()))], ["doc", "row", "n_bytes", "known", "pre", "n"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("t"), F.monotonically_increasing_id().alias("row"))
    found = stored(rows.mapInArrow(sums, "doc long, row long, n_bytes long, known long, pre array<string>, n array<long>"), "frequencies")
    rare = found.select("row", F.explode(F.arrays_zip("pre", "n")).alias("x")).select("row", F.col("x.pre").alias("pre"), F.col("x.n").alias("times"))
    rest = rare.join(known.select("pre", "pieces"), "pre").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("rest"))
    return found.select("doc", "row", "n_bytes", "known").join(rest, "row", "left").select("doc", "n_bytes", (F.col("known") + F.coalesce("rest", F.lit(0))).alias("n_tokens"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = token_counts(documents(spark, sf_dir))
    return df.select(F.col("doc").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
