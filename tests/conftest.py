import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from contentlake.session import get_spark
    s = get_spark(master="local[4]", shuffle_partitions=4, app="contentlake-tests")
    if not s.conf.get("spark.checkpoint.dir", None) and not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cl-test-ckpt-"))
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return SF
