import pytest

from semifold.queries import ORACLE_SQL, QUERIES

from .oracle import SF, same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    same(QUERIES[name](spark, SF), ORACLE_SQL[name])


def test_every_query_without_sql_has_rows(spark):
    for name in sorted(set(QUERIES) - set(ORACLE_SQL)):
        assert QUERIES[name](spark, SF).count() >= 1, name
