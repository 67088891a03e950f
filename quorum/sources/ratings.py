"""District ratings from landed wiki pages: a table function from a page to rows."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import civic, tables


# States and other places, and their codes.
_NAMES = """Alabama AL,Alaska AK,Arizona AZ,Arkansas AR,California CA,Colorado CO,Connecticut CT,Delaware DE,District of Columbia DC,Florida FL,Georgia GA,Hawaii HI,Idaho ID,Illinois IL,Indiana IN,Iowa IA,Kansas KS,Kentucky KY,
Louisiana LA,Maine ME,Maryland MD,Massachusetts MA,Michigan MI,Minnesota MN,Mississippi MS,Missouri MO,Montana MT,Nebraska NE,Nevada NV,New Hampshire NH,New Jersey NJ,New Mexico NM,New York NY,North Carolina NC,North Dakota ND,Ohio OH,
Oklahoma OK,Oregon OR,Pennsylvania PA,Rhode Island RI,South Carolina SC,South Dakota SD,Tennessee TN,Texas TX,Utah UT,Vermont VT,Virginia VA,Washington WA,West Virginia WV,Wisconsin WI,Wyoming WY"""
STATES = {x.strip()[:-3].lower(): x.strip()[-2:] for x in _NAMES.split(",")}


class _Tables(HTMLParser):
    """The cells of each table of class wikitable, row by row."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.open = 0
        self.in_cell = False

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            if self.open or "wikitable" in (dict(attrs).get("class") or ""):
                self.open += 1
                if self.open == 1:
                    self.tables.append([])
        elif self.open and tag == "tr":
            self.tables[-1].append([])
        elif self.open and tag in ("td", "th") and self.tables[-1]:
            self.tables[-1][-1].append("")
            self.in_cell = True

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            self.open -= 1
        elif tag in ("td", "th"):
            self.in_cell = False

    def handle_data(self, data):
        if self.open and self.in_cell:
            self.tables[-1][-1][-1] += data


def rated_places(page: str) -> list[tuple[str, str]]:
    """(place, rating) of the largest table of states and the largest of districts whose heads have a PVI column; place is a row's first cell, or the first two."""
    parser = _Tables()
    parser.feed(page or "")
    best: dict[bool, list[tuple[str, str]]] = {}
    for rows in parser.tables:
        head = [c.strip().lower() for c in rows[0]] if rows else []
        at = next((i for i, c in enumerate(head) if "pvi" in c), None)
        if at is None:
            continue
        places = 2 if "state" in head and "district" in head else 1
        found = [(" ".join(c.replace("\xa0", " ").strip() for c in r[:places]), r[at].strip()) for r in rows[1:] if len(r) > at]
        districts = any(c.isdigit() or "at-large" in p.lower() for p, _ in found for c in p[-4:])
        best[districts] = max(best.get(districts, []), found, key=len)
    return [x for rows in best.values() for x in rows]


def _rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, rating) of pages, a batch of pages at a time."""
    for batch in batches:
        found = [x for page in batch.column("value").to_pylist() for x in rated_places(page)]
        yield pa.RecordBatch.from_pydict({"place": [p for p, _ in found], "rating": [r for _, r in found]}, pa.schema([("place", pa.string()), ("rating", pa.string())]))


def district_ratings(spark: SparkSession, path: str | list[str], congress: int) -> DataFrame:
    """(congress, state, district, pvi, score) of the pages in a folder: "Alabama 1", "West Virginia 2", "Alaska at-large"; a state alone has district -1. States are told by their codes; of other places their names stay."""
    rows = spark.read.text(path, wholetext=True).mapInArrow(_rated, "place string, rating string")
    number = F.regexp_extract("place", r"(\d+)(?:st|nd|rd|th)?\s*$", 1).try_cast("int")
    large = F.lower("place").contains("at-large")
    state = F.trim(F.regexp_replace("place", r"(?i)\s*(?:\d+(?:st|nd|rd|th)?|at-large)\s*$", ""))
    rated = rows.select(F.lit(congress).alias("congress"), F.coalesce(tables.looked_up(STATES, F.lower(state)), state).alias("state"), F.when(large, 0).otherwise(F.coalesce(number, F.lit(-1))).alias("district"), civic.pvi(F.col("rating")).alias("p"))
    return rated.filter(F.col("p").isNotNull()).select("congress", "state", "district", F.col("p.label").alias("pvi"), F.col("p.score").alias("score"))


def place(state: Column, district: Column, congress: Column) -> Column:
    """One text for the place that a rating is of; null without a state."""
    return F.concat(congress.cast("string"), F.lit(":"), state, F.lit(":"), district.cast("string"))


def store(ratings: DataFrame, name: str, buckets: int = 16) -> None:
    """ratings (congress, state, district, pvi, score) as a table bucketed by place, a file a bucket: a look-up reads one bucket, and what is bucketed alike meets it without a shuffle."""
    at = place(F.col("state"), F.col("district"), F.col("congress"))
    ratings.withColumn("place", at).repartition(buckets, "place").sortWithinPartitions("place").write.bucketBy(buckets, "place").sortBy("place").mode("overwrite").saveAsTable(name)


def rated(members: DataFrame, ratings: DataFrame, congress: int) -> DataFrame:
    """members (state, district, chamber, ...) with pvi and score, of their district or, for senators, their state; null where there is no rating.

    members that are a table with a column place, bucketed like the ratings, aren't shuffled.
    """
    known = ratings.select(*(["place"] if "place" in ratings.columns else [place(F.col("state"), F.col("district"), F.col("congress")).alias("place")]), "pvi", "score")
    own = members if "place" in members.columns else members.withColumn("place", member_place(congress))
    met = own.join(known, "place", "left")
    return met.select(*members.columns, "pvi", "score")


def member_place(congress: int) -> Column:
    """The place whose rating a member (state, district, chamber) has."""
    return place(F.col("state"), civic.district_key(F.lower("chamber"), F.col("district")), F.lit(congress))


def rating_of(ratings: DataFrame, congress: int, state: str, district: int | None, chamber: str) -> DataFrame:
    """(pvi, score) of one member's place, or no row: of a bucketed table just its bucket is read."""
    at = -1 if chamber.lower() != "house" else district or 0
    return ratings.filter(F.col("place") == f"{congress}:{state}:{at}").select("pvi", "score")
