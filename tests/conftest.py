import tempfile

import pytest

from passageworks.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", cpus="4", shuffle_partitions=4, spark__driver__memory="4g", spark__checkpoint__dir=tempfile.mkdtemp(prefix="tests-"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
