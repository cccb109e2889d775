import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from tableloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(4, "tests", **{"spark.driver.memory": "8g"})
    yield session
    session.stop()
