import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from marketframe.session import build_session
    ckpt = tempfile.mkdtemp(prefix="mf-test-ckpt-")
    s = build_session(master="local[*]", shuffle_partitions=8, app="marketframe-tests",
                      extra={"spark.checkpoint.dir": ckpt})
    yield s
    s.stop()
