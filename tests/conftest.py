import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from motefield.session import local_session

    session = local_session("tests", 4, "8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
