"""A cache by time: entries (key, payload, fetched_at, expires_at) that hold for a while, negative ones among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def looked_up(asked: DataFrame, cache: DataFrame, key: str, as_of: Column) -> DataFrame:
    """asked, and payload and state of its key as of a moment: all asked rows come back, once each.

    Of a key's entries the last that was fetched by then counts. It is expired if it holds no longer, negative if it says
    that there is nothing (a null payload), else a hit; without an entry, or with a null key, the state is missing. Only a
    hit has a payload. An entry without an end holds for ever. Entries shrink to one a key and task before they meet the keys.
    """
    by_then = cache.filter(F.col("fetched_at") <= as_of)
    entry = F.max_by(F.struct("payload", "expires_at"), F.struct("fetched_at", F.coalesce("payload", F.lit(""))))
    last = by_then.groupBy(F.col(key).alias("__key")).agg(entry.alias("__entry"))
    e = F.col("__entry")
    live = e["expires_at"].isNull() | (e["expires_at"] > as_of)
    state = F.when(e.isNull(), "missing").when(~live, "expired").when(e["payload"].isNull(), "negative").otherwise("hit")
    met = asked.join(last, asked[key] == F.col("__key"), "left")
    return met.select(*[asked[c] for c in asked.columns], F.when(state == "hit", e["payload"]).alias("payload"), state.alias("state"))


def hydrated(rows: DataFrame, keys: list[str], url: str, at: str) -> DataFrame:
    """What a cache in memory is filled with: each key's url that was fetched last, rows without one left out."""
    return rows.filter(F.col(url).isNotNull()).groupBy(*keys).agg(F.max_by(url, F.struct(at, url)).alias(url))
