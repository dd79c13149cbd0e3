import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from llm_cases import make_docs, odd_texts  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    return make_docs(spark, odd_texts()).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return make_docs(spark, [])
