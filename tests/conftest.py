import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from thornwall.config import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=8, spark__thornwall__testTasks="16")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
