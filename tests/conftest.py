import pytest

from tests.harness import duck, make_spark

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return make_spark()


@pytest.fixture(scope="session")
def con():
    return duck(SF)


@pytest.fixture(scope="session")
def entry():
    import __spark_entry__
    return __spark_entry__
