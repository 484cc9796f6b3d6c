import pytest

from tenurekit.llm.store import ship


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship(spark)
