import sys
import tempfile
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]


@pytest.fixture(scope="session")
def spark():
    from tributary.session import build

    session = build("tests", "local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8",
                    spark__driver__memory="6g", spark__ui__showConsoleProgress="false",
                    spark__driver__bindAddress="127.0.0.1",
                    spark__checkpoint__dir="file://" + tempfile.mkdtemp(prefix="tests-"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
