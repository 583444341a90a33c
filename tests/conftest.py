import pytest

from tidemark.session import session


@pytest.fixture(scope="session")
def spark():
    return session("local[4]", shuffle_partitions=4, memory="6g")
