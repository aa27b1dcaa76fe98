import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(autouse=True)
def code_on_workers(spark):
    from playlens.llm.common import small_batches

    small_batches(spark)
