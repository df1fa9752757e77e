import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from quillspark.session import local_session

    session = local_session(cores=4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("OFF")
    return session
