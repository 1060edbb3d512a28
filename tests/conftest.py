import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from trialframe.session import local_session
    s = local_session(8, 4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck_con():
    from oracle_check import duck
    return duck(SF)


@pytest.fixture(scope="session")
def sf_dir():
    return SF
