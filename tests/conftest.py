import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cairn.session import local_session

    session = local_session("tests", cpus=4, partitions=2)
    yield session
    session.stop()
