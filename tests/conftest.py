import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from acadia.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=8)
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="acadia-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def fx(spark):
    from acadia.sources.fixtures import Fixtures
    return Fixtures(spark, SF_SMALL)


def df(spark, rows, schema):
    """Small hand-made frame."""
    return spark.createDataFrame(rows, schema)
