import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from millrace.sources.session import build_session

    s = build_session(
        "local[4]", "tests", spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false", spark__driver__memory="4g",
        spark__sql__warehouse__dir="/tmp/millrace-warehouse",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
