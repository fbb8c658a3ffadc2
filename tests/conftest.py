import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from sheaf.session import local_session

    with tempfile.TemporaryDirectory() as folder:
        session = local_session("4", "sheaf-tests", {"spark.checkpoint.dir": "file://" + folder})
        session.sparkContext.setLogLevel("ERROR")
        yield session
        session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("SHEAF_SF_DIR", "/root/testdata/sf0.001")
