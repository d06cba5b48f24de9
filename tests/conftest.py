import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from duepath.session import local_session

    session = local_session(4, 4)
    yield session
    session.stop()


@pytest.fixture
def tiny_limit(spark):
    """Make almost every group hot, so the split path does all the work."""
    spark.conf.set("duepath.hotGroupRows", "3")
    yield
    spark.conf.unset("duepath.hotGroupRows")


@pytest.fixture(scope="session")
def sf():
    return SF
