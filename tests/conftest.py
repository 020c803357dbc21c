import pytest

from framewright.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", cores=4)
