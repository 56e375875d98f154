import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")


@pytest.fixture(scope="session")
def spark():
    from claimspan.runtime import build_session, ship_code

    session = build_session("tests", "local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    ship_code(session)
    yield session
    session.stop()
