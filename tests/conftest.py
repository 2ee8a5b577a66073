import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from parley.session import build_session, prepare  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[4]", app="parley-tests", shuffle_partitions=4)
    prepare(s)
    yield s
    s.stop()


@pytest.fixture()
def tiny_groups(spark):
    """Many slices for ordered_scan: every key of some size is cut into several."""
    spark.conf.set("parley.ordered.slices", "60")
    yield
    spark.conf.unset("parley.ordered.slices")
