import pytest

import gapline.plans  # noqa: F401
from gapline.registry import ORACLE_SQL, QUERIES
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), ORACLE_SQL[name], sf) == ""


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) > 5 and all(0 <= r["avg_confidence"] <= 1 for r in rows)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
