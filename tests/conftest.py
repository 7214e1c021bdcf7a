import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from busloom.session import HOT_GROUP_ROWS, SMALL_INPUT_BYTES, DENSE_WINDOW_ROWS, make_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = make_session(master="local[8]", shuffle=8)
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def hot(spark):
    """Every input counts as large and groups above 40 rows as hot."""
    spark.conf.set(SMALL_INPUT_BYTES, "0")
    spark.conf.set(HOT_GROUP_ROWS, "40")
    spark.conf.set(DENSE_WINDOW_ROWS, "3")
    yield
    for k in (SMALL_INPUT_BYTES, HOT_GROUP_ROWS, DENSE_WINDOW_ROWS):
        spark.conf.unset(k)
