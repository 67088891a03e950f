"""Keeping an append-only event log and keyed tables: idempotent appends, upserts, merges, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG_KEY = ["source", "source_id", "payload_hash"]


def unused(*tables: DataFrame) -> str:
    """A name that no column of these tables has, in either case."""
    taken, name = {c.lower() for t in tables for c in t.columns}, "__added"
    while name in taken:
        name += "_"
    return name


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order. Rows shrink to one per key and task before they shuffle."""
    packed = F.struct(*df.columns)
    least = df.groupBy(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.min_by(packed, F.struct(*order)).alias("row"))
    return least.select("row.*")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in an order."""
    latest = df.groupBy(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("row"))
    return latest.select("row.*")


def new_rows(batch: DataFrame, log: DataFrame | None, keys: list[str] = LOG_KEY, order: list[Column] | None = None) -> DataFrame:
    """What an append of batch adds to log: the first row of each key, in the order given or as read, that the log doesn't have. Applied twice it adds nothing."""
    at = unused(batch)
    once = first_per_key(batch, keys, order) if order else first_per_key(batch.withColumn(at, F.monotonically_increasing_id()), keys, [F.col(at)]).drop(at)
    return once if log is None else once.join(log.select(*keys), keys, "left_anti")


def upserted(table: DataFrame, changes: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """table with changes: of each key the row that is last in the order, changes before the table's own."""
    new = unused(table, changes)
    both = table.withColumn(new, F.lit(0)).unionByName(changes.withColumn(new, F.lit(1)))
    return latest_per_key(both, keys, [F.col(new), *order]).drop(new)


def merged(log: DataFrame, side: DataFrame, keys: list[str] = LOG_KEY, where: Column | None = None) -> DataFrame:
    """log and the rows of side, where asked for, whose key it doesn't have."""
    side = side if where is None else side.filter(where)
    return log.unionByName(side.join(log.select(*keys), keys, "left_anti"))


def _placed(values: str, number: int) -> Column:
    """The values of a list with the list's number and their places in it."""
    return F.transform(values, lambda v, k: F.struct(F.lit(number).alias("list"), v.cast("string").alias("value"), k.alias("k")))


def collapsed(rows: DataFrame, keys: list[Column], order: list[Column], lists: dict[str, Column]) -> DataFrame:
    """One row for each key: the first in the order, as head; and of each list the distinct values of all the key's rows, in the order in which they are first seen.

    keys are named columns, order is ascending and tells all rows of a key apart, lists are arrays by name (a null one is
    empty, null values in one are left out). A value's place is the least of (its row's, its own in the list), found before
    anything is gathered, so what a key gathers are its distinct values only.
    """
    names = [rows.select(k).columns[0] for k in keys]
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    each = rows.select(*keys, at.alias("__at"), F.struct(*rows.columns).alias("__row"), *[F.coalesce(c, F.array().cast("array<string>")).alias(f"__list{i}") for i, c in enumerate(lists.values())])
    heads = each.groupBy(*names).agg(F.min_by("__row", "__at").alias("head"), F.count("*").alias("rows"))
    placed = [_placed(f"__list{i}", i) for i in range(len(lists))]
    values = each.select(*names, "__at", F.explode(F.concat(*placed)).alias("v")).filter("v.value IS NOT NULL")
    least = values.groupBy(*names, "v.list", "v.value").agg(F.min(F.struct("__at", "v.k")).alias("first"))
    gathered = least.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("first", "list", "value"))).alias("__all"))
    pick = lambda i: F.coalesce(F.transform(F.filter("__all", lambda x: x["list"] == i), lambda x: x["value"]), F.array().cast("array<string>"))
    met = heads.join(gathered.withColumnsRenamed({n: "__" + n for n in names}), [F.col(n).eqNullSafe(F.col("__" + n)) for n in names], "left")
    return met.select(*names, "head", "rows", *[pick(i).alias(n) for i, n in enumerate(lists)])


def with_running(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """df with rank, dense rank, previous and next value and running sum."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({"rank": F.rank().over(w), "dense_rank": F.dense_rank().over(w), "previous": F.lag(value).over(w), "next": F.lead(value).over(w), "running": F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))})


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def append_events(batch: DataFrame, path: str) -> int:
    """Append to the log at path what it doesn't have, partitioned by day and source; how many rows that were.

    Of the log only the partitions of the batch's sources are read: the source is part of the key.
    """
    spark = batch.sparkSession
    fs, at = _files(spark, path)
    log = spark.read.parquet(path) if fs.exists(at(path)) else None
    if log is not None:  # a source's name per kind of landed files, so few
        log = log.filter(F.col("source").isin([r.source for r in batch.select("source").distinct().collect()]))
    added = new_rows(batch, log).withColumn("event_date", F.to_date("occurred_at")).persist()
    n = added.count()
    if n:  # rows of a partition meet in one task, or some if they are many, so there isn't a file for each task and day
        added.hint("rebalance", "event_date", "source").write.mode("append").partitionBy("event_date", "source").parquet(path)
    added.unpersist()
    return n


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite just the partitions that df has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def publish(df: DataFrame, root: str) -> str:
    """Write df as the next version under root and then point CURRENT to it, in one step; readers of the version before aren't disturbed.

    A version's number is claimed by a file that only one writer can create.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, at = _files(spark, root)
    fs.mkdirs(at(root))
    version = 1 + max([0, *(int(n[2:]) for n in (s.getPath().getName() for s in fs.listStatus(at(root))) if n.startswith("v="))])
    while not fs.createNewFile(at(f"{root}/.claim-{version}")):
        version += 1
    df.write.parquet(f"{root}/v={version}")
    out = fs.create(at(f"{root}/.CURRENT.{version}"), True)
    out.write(bytearray(str(version), "ascii"))
    out.close()
    how = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(how, 1)
    over[0] = how.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at(root).toUri(), conf).rename(at(f"{root}/.CURRENT.{version}"), at(f"{root}/CURRENT"), over)
    return f"{root}/v={version}"


def current(spark: SparkSession, root: str) -> DataFrame:
    version = spark.read.text(f"{root}/CURRENT").first()[0]
    return spark.read.parquet(f"{root}/v={version.strip()}")
