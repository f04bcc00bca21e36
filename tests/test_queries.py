"""Every query with SQL gives its rows; the others run with a stable schema."""

import pytest
from compare import assert_same, duck

from vexilar.plans.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    assert_same(queries()[name](spark, sf), duck(sf), oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_runs(spark, sf, name):
    assert queries()[name](spark, sf).count() > 0
