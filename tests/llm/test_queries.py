import pytest

from gapline.llm import queries
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, sf, name):
    assert compare(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], sf) == ""
