import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cinegrid.session import local_session, ready

    s = local_session(4, 4, memory="4g")
    s.sparkContext.setLogLevel("OFF")
    ready(s)
    yield s


@pytest.fixture(scope="session")
def data():
    return DATA
