import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))


@pytest.fixture(scope="session")
def spark():
    from tamis.session import build_session

    session = build_session("tests", "4", shuffle_partitions=4,
                            spark__checkpoint__dir=tempfile.mkdtemp(prefix="tamis-tests-"),
                            spark__python__worker__reuse="true")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
