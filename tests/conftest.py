import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from gridloom.session import get_session

    with tempfile.TemporaryDirectory() as folder:
        session = get_session(
            "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
            spark__sql__warehouse__dir=f"{folder}/warehouse", spark__checkpoint__dir=f"{folder}/shared",
        )
        session.sparkContext.setLogLevel("ERROR")
        yield session
        session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF
