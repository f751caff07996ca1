import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = os.environ.get("TESSEL_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from tessel.session import local_session, ship

    session = local_session(4, 4)
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def medium():
    return f"{DATA}/sf0.01"
