"""Activity grids: weighted daily intensity, a cell for each day, and bands by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .eventlog import unused


def weighted(event_type: Column, weights: dict[str, float], broken: Column | None = None, break_type: str = "", break_weight: float = 0.0) -> Column:
    """Each event's weight by its type, 0 for unknown ones; break_type's events where broken holds have a weight of their own."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    score = F.coalesce(F.try_element_at(table, event_type), F.lit(0.0))
    return score if broken is None else F.when((event_type == break_type) & F.coalesce(broken, F.lit(False)), break_weight).otherwise(score)


def daily_intensity(events: DataFrame, entity: str, at: str, score: Column) -> DataFrame:
    """(entity, day, intensity, cnt) for all entities at once."""
    return events.groupBy(entity, F.to_date(at).alias("day")).agg(F.sum(score).alias("intensity"), F.count("*").alias("cnt"))


def spine(bounds: DataFrame, first: str, last: str) -> DataFrame:
    """A row for each day from the least first to the greatest last."""
    return bounds.agg(F.min(first).alias("a"), F.max(last).alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))


def dense(daily: DataFrame, entity: str) -> DataFrame:
    """daily with a cell for each entity and day of its whole span; missing ones are 0. Days are made per entity, so there is no product of tables."""
    span = daily.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    cells = daily.select(entity).distinct().join(F.broadcast(span)).select(entity, F.explode(F.sequence("a", "b")).alias("day"))
    return cells.join(daily, [entity, "day"], "left").fillna(0, ["intensity", "cnt"])


def thresholds(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, q1, q2, q3, top): of the positive intensities in order, those at the places n/4, n/2 and 3n/4, counted from 0, and the last; by rank, not interpolated.

    Values are counted first, so a key's order is over its different values.
    """
    each = cells.filter("intensity > 0").groupBy(*keys, "intensity").count()
    order = Window.partitionBy(*keys).orderBy("intensity")
    total = Window.partitionBy(*keys)
    each = each.withColumns({"upto": F.sum("count").over(order), "n": F.sum("count").over(total)})
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("n") * q), F.col("intensity")))
    return each.groupBy(*keys).agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"), F.max("intensity").alias("top"))


def banded(cells: DataFrame, keys: list[str]) -> DataFrame:
    """cells and their band from 0 to 4 among those with the same keys; a threshold belongs to the band below it."""
    at = unused(cells)
    quarters = thresholds(cells, keys).select(*keys, F.struct("q1", "q2", "q3").alias(at))
    df = cells.join(quarters, keys, "left") if keys else cells.join(F.broadcast(quarters))
    x, q = F.col("intensity"), F.col(at)
    band = F.when(x.isNull() | (x <= 0) | q["q1"].isNull(), 0).when(x <= q["q1"], 1).when(x <= q["q2"], 2).when(x <= q["q3"], 3).otherwise(4)
    return df.withColumn("band", band).drop(at)


def week_place(day: Column, first: Column) -> tuple[Column, Column, Column]:
    """(Sunday of its week, column, row from 0 for Sunday) of a day in a grid that begins with the week of first."""
    sunday = lambda d: F.date_sub(d, F.dayofweek(d) - 1)
    return sunday(day), F.floor(F.datediff(sunday(day), sunday(first)) / 7).cast("int"), F.dayofweek(day) - 1
