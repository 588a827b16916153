import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fieldwatch.session import BLOCK_ROWS, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # Blocks of seven rows: every windowed operator crosses block borders in the tests.
    session = local_session(4, 4, spark__sql__adaptive__coalescePartitions__enabled="true")
    session.conf.set(BLOCK_ROWS, "7")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
