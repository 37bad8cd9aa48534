import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def ws(spark):
    from convrec.llm.common import workers_import

    workers_import(spark)
    return spark
