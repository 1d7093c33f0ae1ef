import pytest

from monthloom import build_session
from monthloom.plans import tables
from monthloom.session import written
from tests.oracle import connect

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", master="local[8]", spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    return connect(SF_DIR)


@pytest.fixture(scope="session")
def stored(spark):
    """Surveillance and weather written once, for the many queries that start from them."""
    return {
        "surveillance": written(tables.surveillance(spark, SF_DIR), "surveillance"),
        "weather": written(tables.weather(spark, SF_DIR), "weather"),
    }


@pytest.fixture
def quick_tables(stored, monkeypatch):
    monkeypatch.setattr(tables, "surveillance", lambda spark, sf_dir: stored["surveillance"])
    monkeypatch.setattr(tables, "weather", lambda spark, sf_dir: stored["weather"])
