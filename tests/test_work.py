"""What plans must not do: work that is repeated for each line, kind or pass. Each held for an earlier state of the code not to."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from quorum.text import clean


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_page_is_cleaned_once(spark):
    """the markup's patterns stand once in the plan; before, each line asked for the line before it by cleaning the page anew."""
    page = "<p>a</p>\n\n\n<br><b>b &amp; &#99;</b>\n" * 3000
    df = spark.createDataFrame([(page,)], "html string").select(clean.text_lines(F.col("html")).alias("body"))
    assert plan(df).count("<!--") == 1
    assert df.first()[0] == "\n\n".join(["a", "b & c"] * 3000)


def test_documents_are_read_once(spark, tmp_path):
    """before, a bill's was read for each kind of event, a roll call's again for its parties' majorities."""
    from quorum.sources import readers

    (tmp_path / "x.xml").write_text("<all></all>")
    assert plan(readers.bill_status(spark, str(tmp_path))[1]).count("Relation [") == 1
    assert plan(readers.house_votes(spark, str(tmp_path))).count("Relation [") == 1


def test_landed_pages_are_packed_files_of_one_folder(spark):
    """before, each page had a folder and its text was dealt twice."""
    from quorum.plans.landed import put_pages

    path = put_pages(spark.range(600), "some", F.col("id"), "f", F.struct("id")).removeprefix("file://")
    found = [n for n in os.listdir(path) if not n.startswith((".", "_"))]
    assert len(found) == 3 and all(n.endswith(".txt.gz") for n in found)


def test_a_label_is_split_once(spark):
    """before, each thing that a label tells split it anew."""
    from quorum.functions import civic

    df = spark.range(1).select(F.concat(F.lit("H. Con. Res. "), F.col("id").cast("string")).alias("label")).select(civic.bill_of_label(F.col("label")).alias("b"))
    assert plan(df).count("split(") == 1
    said = spark.createDataFrame([("H. Con. Res. 5",), ("QUORUM",), ("X 1",), (None,)], "label string").select(civic.bill_of_label(F.col("label")).alias("b"))
    assert [r.b and tuple(r.b) for r in said.collect()] == [("hconres", 5), None, None, None]


def test_mentions_pass_by_their_bills_unsorted(spark):
    """F8, F12, F13: before, Spark might sort all mentions of a bill in one task."""
    from quorum.operators import matching

    mentions = spark.createDataFrame([("b", "tax act", ["TAX"])], "bill_id string, mention_text string, issue_codes array<string>")
    scores = matching.scored(mentions, spark.createDataFrame([("b", "tax act", "Taxation")], "bill_id string, title string, policy_area string"))
    physical = scores._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in physical and "SortMergeJoin" not in physical


def test_an_append_writes_a_file_a_day(spark, tmp_path):
    """before, each task wrote a file for each day and source."""
    from quorum.operators import eventlog

    rows = spark.range(4000).repartition(8).select(F.lit("s").alias("source"), F.col("id").cast("string").alias("source_id"), F.lit("h").alias("payload_hash"), F.timestamp_seconds(F.col("id") % 3 * 86400).alias("occurred_at"))
    assert eventlog.append_events(rows, f"{tmp_path}/log") == 4000
    assert [len([f for f in files if f.endswith(".parquet")]) for _, _, files in os.walk(f"{tmp_path}/log") if any(f.endswith(".parquet") for f in files)] == [1, 1, 1]
