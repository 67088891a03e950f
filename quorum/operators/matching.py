"""How well lobbying mentions fit the bills that they name: scores of all mentions, each bill's clients, a report of misfits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.civic import match_band, match_score, tokens, without_references

#: From this score on a client is shown on a bill's page.
SHOWN = 0.3
# The periods of filings in order, and how they are called.
PERIODS = {"first_quarter": "Q1", "second_quarter": "Q2", "third_quarter": "Q3", "fourth_quarter": "Q4"}


def scored(mentions: DataFrame, bills: DataFrame, stop_words: tuple[str, ...] = tables.STOP_WORDS) -> DataFrame:
    """mentions (bill_id, mention_text, issue_codes, ...) with score, band and has_mention, against bills (bill_id, title, policy_area).

    Mentions meet just the bill that they name, by its id; words are made once a bill and once a mention. A mention of an
    unknown bill is scored against an empty title without a policy area; one without a bill's id is left out.
    """
    words = lambda c: tokens(without_references(F.col(c)), stop_words)
    known = bills.select("bill_id", words("title").alias("__title"), F.col("policy_area").alias("__area"))
    # bills are held and mentions pass by, unsorted, whatever a bill has of them; words are made below the join, where conditions on the score don't make them again
    met = mentions.filter(F.col("bill_id").isNotNull()).withColumn("__mention", words("mention_text")).join(known.hint("shuffle_hash"), "bill_id", "left")
    title = F.coalesce("__title", F.array().cast("array<string>"))
    score = match_score(title, F.col("__mention"), tables.issue_fit(F.col("issue_codes"), F.col("__area")))
    out = met.withColumns({"score": score, "has_mention": F.size("__mention") > 0}).drop("__title", "__area", "__mention")
    return out.withColumn("band", match_band(F.col("score")))


def clients_of_bills(scores: DataFrame, most: int = 10, least: float = SHOWN) -> DataFrame:
    """Each bill's clients, most at the most: filings, amount, the label of the latest period (by year, then quarter), the first six issue codes, the best score of all their filings and its band, and their place.

    Clients whose best score is below least aren't counted; the others are ranked by filings, amount (null last) and id. All
    is one aggregate by bill and client that tasks begin on their own rows.
    """
    quarter = F.array_position(F.array(*map(F.lit, PERIODS)), F.col("filing_period"))  # 0 for all other periods
    codes = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_set("issue_codes")))), 1, 6)
    per = scores.filter(F.coalesce("client_id", F.lit("")) != "").groupBy("bill_id", "client_id").agg(
        F.max("client_name").alias("client_name"), F.count("*").alias("filings"), F.sum("amount").cast("double").alias("amount"), F.max(F.struct("filing_year", quarter.alias("quarter"), "filing_period")).alias("latest"), codes.alias("issue_codes"), F.max("score").alias("best"),
    )
    place = F.row_number().over(Window.partitionBy("bill_id").orderBy(F.desc("filings"), F.desc_nulls_last("amount"), "client_id"))
    shown = per.filter(F.col("best") >= least).withColumn("place", place).filter(F.col("place") <= most)
    year, period = F.col("latest.filing_year"), F.col("latest.filing_period")
    label = F.concat(year.cast("string"), F.lit(" "), F.coalesce(tables.looked_up(PERIODS, period), period))
    return shown.select("bill_id", "client_id", "client_name", "filings", "amount", F.coalesce(label, F.lit("")).alias("latest_period"), "issue_codes", "best", match_band(F.col("best")).alias("band"), "place")


def bands(scores: DataFrame) -> DataFrame:
    """(band, n, with_mention, pct) of all mentions."""
    per = scores.groupBy("band").agg(F.count("*").alias("n"), F.count_if("has_mention").alias("with_mention"))
    return per.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def misfits(scores: DataFrame, order: list[str], bills: int = 10, examples: int = 3, most_chars: int = 80) -> DataFrame:
    """The bills with the most mentions that don't fit, and the first examples of each in an order: (bill_id, n, client_name, snippet, example)."""
    wrong = scores.filter("band = 'false_positive'")
    top = wrong.groupBy("bill_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bill_id").limit(bills)
    place = F.row_number().over(Window.partitionBy("bill_id").orderBy(*order))
    theirs = scores.join(F.broadcast(top.select("bill_id")), "bill_id", "left_semi")  # which Spark moves before the scores: only these bills' mentions are scored again
    first = theirs.filter("band = 'false_positive'").join(F.broadcast(top), "bill_id").withColumn("example", place).filter(F.col("example") <= examples)  # as many rows as bills are asked for
    return first.select("bill_id", "n", F.coalesce("client_name", F.lit("?")).alias("client_name"), F.substring(F.coalesce("mention_text", F.lit("")), 1, most_chars).alias("snippet"), "example")
