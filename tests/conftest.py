import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from veritable.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """A table from rows and a schema string."""

    def build(rows, schema):
        if rows and not isinstance(rows[0], tuple):
            rows = [(r,) for r in rows]
        return spark.createDataFrame(rows, schema)

    return build


def told(df):
    """Candidates as {columns: affected count}."""
    return {",".join(r["columns"]): r["affected_count"] for r in df.collect()}
