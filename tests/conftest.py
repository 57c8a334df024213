import pytest

from graphloom.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", 4)
    yield s
    s.stop()
