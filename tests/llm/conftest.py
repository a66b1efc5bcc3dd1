import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import cases  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    return cases.documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return cases.frame(spark, rows).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return cases.frame(spark, [])
