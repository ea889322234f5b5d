import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from chainevents.session import local_session, ship_package


@pytest.fixture(scope="session")
def spark():
    session = local_session(name="tests")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture
def folder():
    """A new folder per test; never cleared by the tests themselves."""
    return tempfile.mkdtemp(prefix="spark-")
