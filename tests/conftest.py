import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tallyhouse.session import get_session
    s = get_session("local[4]", app_name="tallyhouse-tests", shuffle_partitions=4)
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tallyhouse-test-"))
    yield s


@pytest.fixture()
def scratch(spark):
    """A fresh folder under the session's checkpoint folder."""
    from tallyhouse.session import scratch_root
    return tempfile.mkdtemp(prefix="t-", dir=scratch_root(spark))


@pytest.fixture()
def f1(spark):
    from fixtures_f1 import F1, raw_frames
    return raw_frames(spark, F1)
