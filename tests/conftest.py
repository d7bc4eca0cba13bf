import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    import tempfile
    from ascribe.session import local_session
    wh = tempfile.mkdtemp(prefix="ascribe-wh-")
    s = local_session("*", shuffle_partitions=8, app="ascribe-tests", driver_memory="4g",
                      extra={"spark.sql.warehouse.dir": wh})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SMOKE):
        pytest.skip("driver test data not present")
    return SMOKE
