"""Queries that SQL can say, and those that only have to run, over the smallest test tables."""

import pytest

from corpusloom.llm import queries
from tests.compare import plain

ORACLE = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(name, spark, sf, duck):
    got = queries.queries()[name](spark, sf).toPandas()
    if name in ORACLE:
        want = duck.execute(ORACLE[name]).df()
        assert sorted(want.columns) == sorted(got.columns) and plain(got) == plain(want)
    if name.endswith("_found"):
        assert not got.duplicated().any()
