import os
import sys

import pytest

os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 4g --conf spark.ui.showConsoleProgress=false pyspark-shell")
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session

    session = local_session("tests", "4", partitions=4)
    yield session
    session.stop()
