from __future__ import annotations

import os
import sys

import duckdb
import pandas as pd
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quorum.session import session

    s = session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.sql.warehouse.dir": f"{tmp_path_factory.mktemp('tables')}"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def same_rows(spark_df, duck_rel):
    """Both results, their columns by name, as sorted rows of text with floats to nine digits."""

    def rows(pdf):
        def text(v):
            if v is None or v is pd.NA or v != v:
                return "null"
            return f"{v:.9g}" if isinstance(v, float) else str(v.tolist() if hasattr(v, "tolist") else v).removesuffix(" 00:00:00")

        pdf = pdf[sorted(pdf.columns)]
        return list(pdf.columns), sorted(tuple(text(v) for v in r) for r in pdf.astype(object).itertuples(index=False))

    a, b = rows(spark_df.toPandas()), rows(duck_rel.df())
    assert a[0] == b[0]
    assert a[1] == b[1]
