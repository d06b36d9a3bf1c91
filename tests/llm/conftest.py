import pytest

from krigmesh.llm.common import clean_scratch


@pytest.fixture(scope="session", autouse=True)
def clean(spark):
    yield
    clean_scratch(spark)
