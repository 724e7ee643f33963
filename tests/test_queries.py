"""Every registered core query: it runs, and gives the rows of its SQL where there is one."""

import pytest

from corpusloom.plans import catalogue
from tests.compare import plain

QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLE:
        want = duck.execute(ORACLE[name]).df()
        assert sorted(want.columns) == sorted(got.columns)
        assert plain(got) == plain(want)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_core_does_not_import_the_subpackage():
    from pathlib import Path

    import corpusloom

    root = Path(corpusloom.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "corpusloom.llm" not in path.read_text()
