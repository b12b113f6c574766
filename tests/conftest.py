import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from tandemlens.session import BROADCAST_ROWS_CONF, SPLIT_ROWS_CONF, local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "4g", "tests")
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture
def skewed(spark):
    """Limits so small that every hot-key route is taken."""
    spark.conf.set(SPLIT_ROWS_CONF, "7")
    spark.conf.set(BROADCAST_ROWS_CONF, "0")
    yield spark
    spark.conf.unset(SPLIT_ROWS_CONF)
    spark.conf.unset(BROADCAST_ROWS_CONF)
