import pytest

from vellum.session import local_session

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(4, memory="6g", **{"spark.sql.shuffle.partitions": "4"})
