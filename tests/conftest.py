import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from bench import session

    s = session("4")
    yield s
    s.stop()


@pytest.fixture
def rows(spark):
    """Rows of a DataFrame as dicts, sorted by the given columns."""

    def get(df, *order):
        return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]

    return get
