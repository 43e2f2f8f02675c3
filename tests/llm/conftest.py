import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def docs(spark):
    import awkward

    return awkward.documents(spark).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    import awkward

    return awkward.none(spark)
