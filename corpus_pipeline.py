"""From raw documents to packed sequences: quality rules, line dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the columns
of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum.llm import jaccard, linededup, mixing, packing, quality
from quorum.llm.common import documents, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold to the rules, each judged by itself: null and empty texts go, repeated rows all stay or go."""
    return quality.kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a larger id keeps; n_chars is counted anew.

    Rows of one id lose the same lines; a null id is one document, smaller than all others; a null text stays null.
    """
    return linededup.with_lines(docs).select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row: that with the least id, a null one last, of equal ids the first read.

    Rows are told apart by their place: of repeated rows one stays, rows with one id and other texts are judged by their
    texts. Documents without words are groups of their own.
    """
    return jaccard.kept_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in shuffled shards. A null source is one of its own; rows with one id and text are taken alike."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The placed pieces of the documents' tokens: a row's are its own, repeated or not; a null or empty text is an end alone."""
    return packing.packing_digest(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("pack", pack),
]

#: Hashes deal the mix's blocks and a tokenizer makes the pieces; neither can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
