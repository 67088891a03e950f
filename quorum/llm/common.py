"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The ASCII white space itself, for trim().
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; where it is unset, one of our own if all run on one machine, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        application = spark.sparkContext.applicationId
        if application not in _OWN:
            _OWN[application] = "file://" + tempfile.mkdtemp(prefix="quorum-")
        base = _OWN[application]
    return base.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written once as a table in the shared folder: cuts the lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def prefix(df: DataFrame) -> str:
    """What none of df's columns begins with, in either case: two underscores, or as many more as it takes. Columns that operators add to df's own begin with it."""
    pre = "__"
    while any(c.startswith(pre) for c in df.columns):
        pre += "_"
    return pre


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; lower() does the same, faster, where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def sized(df: DataFrame, most_rows: int, most_bytes: int = 64 << 20) -> DataFrame:
    """df, a stored table, marked for broadcast if its rows and the bytes of its strings are within bounds; else left to a shuffle join."""
    wide = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    rows, size = df.agg(F.count("*"), F.sum(sum(wide, F.lit(0).cast("long")))).first()
    return F.broadcast(df) if rows <= most_rows and (size or 0) <= most_bytes else df


def most_frequent(df: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of df with the highest counts: as many as there are of whole grades of counts, most at the most.

    Grades are sixteenths of powers of two. Their sizes, some hundred rows, decide; no task sorts or sends more than it keeps.
    """
    grade = F.floor(F.log2(F.col(count)) * 16)
    left, cut = most, None
    for g, n in sorted(df.groupBy(grade.alias("g")).agg(F.count("*").alias("n")).collect(), reverse=True):
        if n > left:
            break
        left, cut = left - n, g
    return df.filter(F.lit(False) if cut is None else grade >= cut)
