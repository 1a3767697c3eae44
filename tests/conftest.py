import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from valuescope.session import build_session
    s = build_session(master="local[*]", shuffle_partitions=8, app="valuescope-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def registry():
    from valuescope import catalog
    return catalog.load_all()


@pytest.fixture(scope="session")
def duck_small():
    from valuescope.parity import duck_connect
    return duck_connect(SMALL)


@pytest.fixture(scope="session")
def duck_medium():
    from valuescope.parity import duck_connect
    return duck_connect(MEDIUM)
