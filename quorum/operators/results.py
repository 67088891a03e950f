"""Results kept by content: what a computation gave for its inputs' digests is never computed again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .eventlog import _files, current, first_per_key, publish


def _stored(spark: SparkSession, path: str, part: str) -> DataFrame | None:
    fs, at = _files(spark, path)
    return current(spark, f"{path}/{part}") if fs.exists(at(f"{path}/{part}/CURRENT")) else None


def _added(df: DataFrame, path: str, part: str) -> None:
    """df appended to the published version, or published as the first. An append is one job: its rows are seen when it ends."""
    spark = df.sparkSession
    fs, at = _files(spark, path)
    if fs.exists(at(f"{path}/{part}/CURRENT")):
        version = spark.read.text(f"{path}/{part}/CURRENT").first()[0].strip()
        df.write.mode("append").parquet(f"{path}/{part}/v={version}")
    else:
        publish(df, f"{path}/{part}")


def computed(asked: DataFrame, keys: list[str], path: str, compute: Callable[[DataFrame], DataFrame], now: Column) -> DataFrame:
    """asked, and the results of its rows from the store at path; those that the store lacks are computed first, once a key, and added.

    keys (digests of the inputs and the parameters) tell a result; a null in a key is a value of its own. compute takes one
    row of asked for each missing key and returns the keys and the results. If nothing is missing it isn't called and the
    store isn't written, but for the uses: each key's moments of use, which `evict` goes by. A key for which compute
    returns no row has null results and is missing again next time. One writer at a time.
    """
    spark = asked.sparkSession
    known = _stored(spark, path, "results")
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    have = None if known is None else known.select(*keys)
    missing = asked if have is None else asked.join(have, same(asked, have), "left_anti")
    if not missing.isEmpty():
        fresh = compute(first_per_key(missing, keys, [F.lit(1)]))
        _added(fresh, path, "results")
        known = _stored(spark, path, "results")
    _added(asked.select(*keys).distinct().withColumn("used_at", now), path, "uses")
    if known is None:
        return asked
    results = [c for c in known.columns if c not in keys]
    return asked.join(known, same(asked, known), "left").select(*[asked[c] for c in asked.columns], *[known[c] for c in results])


def evict(spark: SparkSession, path: str, keys: list[str], keep: int) -> int:
    """Keeps the results of the keep keys used last, of equal moments the lesser keys; how many are left. Readers of the version before aren't disturbed."""
    known, uses = _stored(spark, path, "results"), _stored(spark, path, "uses")
    if known is None:
        return 0
    last = uses.groupBy(*keys).agg(F.max("used_at").alias("used_at"))
    last = last.orderBy(F.desc("used_at"), *keys).limit(keep)
    used = last.select(*[F.col(k).alias("__" + k) for k in keys])
    left = known.join(used, [known[k].eqNullSafe(used["__" + k]) for k in keys], "left_semi")
    publish(left, f"{path}/results")
    publish(last, f"{path}/uses")
    return _stored(spark, path, "results").count()
