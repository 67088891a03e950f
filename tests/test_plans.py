import pytest
from conftest import DATA, same_rows

import __spark_entry__
from quorum.plans import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    if name in ORACLE_SQL:
        same_rows(found, duck.sql(ORACLE_SQL[name]))
    else:
        assert found.count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
