import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = Path(os.environ.get("QUILLSPARK_DATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    from quillspark.session import local_session, ship

    s = local_session("4", 4)
    s.sparkContext.setLogLevel("OFF")
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    d = DATA / "sf0.001"
    if not d.exists():
        pytest.skip("no test tables")
    return str(d)
