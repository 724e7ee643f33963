import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from corpusloom.session import build

    session = build("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="2g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    if not DATA.exists():
        pytest.skip("no test data")
    return str(DATA)


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in os.listdir(sf):
        path = f"{sf}/{name}"
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con
