import pytest

from quillnet.session import local_session

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return DATA


@pytest.fixture
def edge_frame(spark):
    def build(pairs, weight=1):
        rows = [(min(a, b), max(a, b), weight) for a, b in pairs]
        return spark.createDataFrame(rows, "e1 long, e2 long, weight long")

    return build
