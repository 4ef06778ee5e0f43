import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tests.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    yield session
    session.stop()


@pytest.fixture
def readings(spark):
    """Build a readings DataFrame from (id, ts_ms, value, house, household, plug[, property]) tuples."""
    from plugload.schema import READING

    def make(rows):
        full = [(r[0], r[1], float(r[2]), r[6] if len(r) > 6 else 1, r[5], r[4], r[3]) for r in rows]
        return spark.createDataFrame(full, READING)

    return make
