import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from riskframe.session import get_spark
    s = get_spark("riskframe-tests", cores="*", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def duck():
    from harness import duck_connection
    return duck_connection(SMALL)
