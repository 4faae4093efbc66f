import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from confsieve.session import local_session

    s = local_session("tests", "8")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
