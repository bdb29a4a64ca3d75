"""Every query with SQL against its oracle, on the smallest tables."""

import pytest

from plumbline import queries as Q

from .oracle import check


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_oracle(spark, sf, name):
    check(spark, Q.queries()[name], Q.oracle_sql()[name], sf)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
