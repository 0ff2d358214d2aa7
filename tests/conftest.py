import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from compare import make_duck, make_spark  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = make_spark()
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    return make_duck(SF)
