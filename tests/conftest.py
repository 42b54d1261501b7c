import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from sdlweave.runtime import session

    os.environ.setdefault("SDLWEAVE_DRIVER_MEMORY", "4g")
    s = session("tests", "4", 4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in os.listdir(data):
        con.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{data}/{f}')")
    return con
