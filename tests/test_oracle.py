"""Every query that has SQL gives its rows, on the smallest tables."""

import pytest

from compare import compare

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE and not n.startswith("op")])
def test_against_sql(spark, name):
    n, fault = compare(spark, SF, name, QUERIES[name], ORACLE[name])
    assert fault is None and n > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
