import pytest

from lodeline.session import build, reachable


@pytest.fixture(scope="session")
def spark():
    session = reachable(build(cpus=4, shuffle_partitions=4, memory="4g"))
    yield session
    session.stop()
