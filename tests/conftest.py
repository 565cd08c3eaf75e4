import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from bidloom.session import spark_session


@pytest.fixture(scope="session")
def spark():
    session = spark_session("tests", "local[8]", 4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
