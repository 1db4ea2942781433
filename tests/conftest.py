import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from pyspark import cloudpickle  # noqa: E402

import oracle  # noqa: E402
import pairmill  # noqa: E402
from pairmill.session import local_session  # noqa: E402

cloudpickle.register_pickle_by_value(pairmill)


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "pairmill-tests")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    return oracle.connect(sf)
