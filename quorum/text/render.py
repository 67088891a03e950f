"""Banded grids of all entities at once as text or SVG: weeks from Sunday as columns, a row for each day of the week.

An entity's cells shrink to one row, a map by day that its window bounds; all that is drawn is made from it by column
expressions, so nothing goes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The signs of the bands, and the names of months and of the days that are labelled (by their row).
SHADES = "·░▒▓█"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
DAYS = {1: "Mon", 3: "Wed", 5: "Fri"}


def _framed(cells: DataFrame, entity: str) -> DataFrame:
    """(entity, first, last, start, weeks, cells) of cells (entity, day, band[, intensity, cnt, house, senate]): the days from the first to the last, the Sunday that the grid begins with, and a map from day to cell. Of a day that is there twice the greater cell counts."""
    optional = {"intensity": "double", "cnt": "long", "house": "boolean", "senate": "boolean"}
    fields = [F.coalesce(F.col("band"), F.lit(0)).cast("int").alias("band"), *[(F.col(c) if c in cells.columns else F.lit(None)).cast(t).alias(c) for c, t in optional.items()]]
    once = cells.filter(F.col("day").isNotNull()).groupBy(entity, "day").agg(F.max(F.struct(*fields)).alias("cell"))
    per = once.groupBy(entity).agg(F.min("day").alias("first"), F.max("day").alias("last"), F.map_from_entries(F.collect_list(F.struct("day", "cell"))).alias("cells"))
    per = per.withColumn("start", F.date_sub("first", F.dayofweek("first") - 1))
    return per.withColumn("weeks", F.floor(F.datediff("last", "start") / 7).cast("int") + 1)


def _day(week: Column, row: Column) -> Column:
    return F.date_add("start", (week * 7 + row).cast("int"))


def _columns() -> Column:
    return F.sequence(F.lit(0), F.col("weeks") - 1)


def as_text(cells: DataFrame, entity: str = "entity") -> DataFrame:
    """(entity, text): seven lines, a sign for each day: its band's, or a blank outside the entity's days and where a cell is missing."""

    def sign(week: Column, row: Column) -> Column:
        cell = F.try_element_at("cells", _day(week, row))
        return F.when(cell.isNull(), " ").otherwise(F.element_at(F.array(*map(F.lit, SHADES)), F.coalesce(cell["band"], F.lit(0)) + 1))

    lines = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda row: F.array_join(F.transform(_columns(), lambda week: sign(week, row)), ""))
    return _framed(cells, entity).select(entity, F.array_join(lines, "\n").alias("text"))


def as_svg(cells: DataFrame, entity: str = "entity", size: int = 12, gap: int = 3, labels: bool = True, recess: bool = False, stripes: bool = False) -> DataFrame:
    """(entity, svg): a box for each day from the entity's first to its last, of the class of its band, with a title.

    labels: names of days at the left, and of months above the first week that ends within a month's first seven days, each
    month's once. recess: boxes without a band on weekdays when neither chamber sits are of the class recess. stripes: below
    a week in which the house or the senate sits a bar for each. Whether they sit is said by cells (house, senate); a day
    without a cell has band 0 and no session.
    """
    left, top, pitch = (28, 18, size + gap) if labels else (4, 4, size + gap)
    text = lambda x: F.lit(x) if isinstance(x, (str, int)) else x.cast("string")
    said = lambda *parts: F.concat(*[text(p).cast("string") for p in parts])
    x_of = lambda week: week * pitch + left

    def box(k: Column) -> Column:
        day = F.date_add("first", k)
        at = F.datediff(day, "start")
        cell = F.try_element_at("cells", day)
        band = F.coalesce(cell["band"], F.lit(0))
        quiet = (band == 0) & ~F.coalesce(cell["house"], F.lit(False)) & ~F.coalesce(cell["senate"], F.lit(False)) & ~F.dayofweek(day).isin(1, 7)
        kind = F.when(quiet, "recess").otherwise(said("band", band)) if recess else said("band", band)
        title = F.concat(day.cast("string"), F.coalesce(said(" · intensity ", F.bround(cell["intensity"], 1)), F.lit("")), F.coalesce(said(" · ", cell["cnt"], " events"), F.lit("")))
        place = said('<rect x="', x_of(F.floor(at / 7)), '" y="', at % 7 * pitch + top, f'" width="{size}" height="{size}" rx="2" class="')
        return F.concat(place, kind, said('" data-day="', day, '"><title>'), title, F.lit("</title></rect>"))

    def sits(week: Column, chamber: str) -> Column:
        return F.exists(F.sequence(F.lit(0), F.lit(6)), lambda row: F.coalesce(F.try_element_at("cells", _day(week, row))[chamber], F.lit(False)))

    def bars(chamber: str, y: int) -> Column:
        inside = F.filter(_columns(), lambda week: sits(week, chamber))
        return F.transform(inside, lambda week: said('<rect x="', x_of(week), f'" y="{y}" width="{size}" height="3" rx="1" class="{chamber}"/>'))

    df = _framed(cells, entity)
    # weeks that end within a month's first seven days; of several years' same month the first
    ends = F.filter(_columns(), lambda week: F.dayofmonth(_day(week, F.lit(6))) <= 7)
    month = lambda week: F.month(_day(week, F.lit(6)))
    df = df.withColumn("ends", ends).withColumn("months", F.transform("ends", month))
    named = F.filter("ends", lambda week, i: F.array_position("months", month(week)) == i + 1)
    parts = [F.transform(F.sequence(F.lit(0), F.datediff("last", "first")), box)]
    if labels:
        above = F.transform(named, lambda week: said('<text x="', x_of(week), '" y="12">', F.element_at(F.array(*map(F.lit, MONTHS)), month(week)), "</text>"))
        parts = [F.array(*[F.lit(f'<text x="2" y="{top + row * pitch + size - 2}">{name}</text>') for row, name in DAYS.items()]), above, *parts]
    under = top + 7 * pitch + 4
    if stripes:
        parts += [bars("house", under), bars("senate", under + 5)]
    width, height = F.col("weeks") * pitch + left + 4, under + (12 if stripes else 0)
    head = said('<svg xmlns="http://www.w3.org/2000/svg" width="', width, f'" height="{height}" viewBox="0 0 ', width, f' {height}" font-size="10">')
    return df.select(entity, F.concat(head, F.array_join(F.concat(*parts), ""), F.lit("</svg>")).alias("svg"))
