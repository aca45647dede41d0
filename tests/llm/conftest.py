import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
for p in (ROOT, ROOT / "tests"):
    sys.path.insert(0, str(p))


@pytest.fixture(scope="session")
def spark():
    from motefield.session import local_session

    session = local_session("tests", 4, "8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
