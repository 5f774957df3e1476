"""Every registered query of the engine against its SQL."""

import pytest

from sedimark.plans import registry
from tests.conftest import SMALL
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_query_has_sql_or_a_brute_force_test():
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"average_path_length"}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    same(registry.queries()[name](spark, SMALL), con, registry.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
