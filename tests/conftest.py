import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from textloom.session import get_session

    shared = tmp_path_factory.mktemp("shared")
    s = get_session("tests", "local[8]", spark__checkpoint__dir=f"file://{shared}", spark__sql__warehouse__dir=str(shared / "warehouse"), spark__driver__memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
