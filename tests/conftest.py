from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]


@pytest.fixture(scope="session")
def spark():
    from plantpulse.session import build_session

    s = build_session(
        "tests", "local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8", spark__driver__memory="8g"
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
