import pytest
from conftest import DATA, same_rows
from pyspark.sql import functions as F

from quorum.plans import QUERIES
from quorum.plans.registry import ORACLE_SQL

NAMES = ["streaming_daily_grid", "streaming_dedupe", "streaming_sessions", "streaming_sliding_week"]


@pytest.mark.parametrize("name", NAMES)
def test_results_are_files(spark, name):
    assert QUERIES[name](spark, DATA).inputFiles()  # none, if the driver holds the rows


@pytest.mark.parametrize("name", ["streaming_daily_grid", "streaming_dedupe"])
def test_several_batches(spark, duck, tmp_path, name):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartitionByRange(20, "ts").sortWithinPartitions("ts").write.parquet(f"file://{tmp_path}/events.parquet")
    same_rows(QUERIES[name](spark, f"file://{tmp_path}"), duck.sql(ORACLE_SQL[name]))
    events.filter(F.lit(False)).write.parquet(f"file://{tmp_path}/no/events.parquet")
    assert QUERIES[name](spark, f"file://{tmp_path}/no").count() == 0
