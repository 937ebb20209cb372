import pytest

from panelspark.storage import release
from tests.session import session


@pytest.fixture(scope="session")
def spark():
    running = session()
    yield running
    release(running)


@pytest.fixture(scope="module", autouse=True)
def scratch(spark):
    """Each module's intermediate tables go when it ends."""
    yield
    release(spark)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
