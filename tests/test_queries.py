"""Every registered query against its SQL on the smallest tables; those without SQL are in test_brute.py."""

import pytest
from oracle import SMALL, same

from seqloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, name):
    same(catalog.QUERIES[name](spark, SMALL), catalog.SQL[name], SMALL)


def test_all_are_tested():
    import test_brute

    without = set(catalog.QUERIES) - set(catalog.SQL)
    assert without == {n for n in without if hasattr(test_brute, f"test_{n}")}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
