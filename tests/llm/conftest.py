import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from small import SMALL  # noqa: E402


@pytest.fixture(scope="session")
def llm(spark):
    from sharetide.llm.common import tuned

    return tuned(spark)


@pytest.fixture(scope="session")
def texts(llm):
    return [(r.doc_id, r.text) for r in llm.read.parquet(f"{SMALL}/documents.parquet").collect()]


@pytest.fixture(scope="session")
def docs(llm):
    return llm.read.parquet(f"{SMALL}/documents.parquet")
