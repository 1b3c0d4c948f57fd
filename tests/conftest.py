import pytest

from rankweave.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", cpus=4, shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
