import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gavel.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", partitions=4, name="tests")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Collect a frame as a sorted list of plain tuples."""
    def collect(df, *columns):
        out = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
        return sorted(out, key=lambda t: tuple((v is None, str(type(v)), v if not isinstance(v, (list, dict)) else str(v)) for v in t))

    return collect
