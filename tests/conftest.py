import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from lexstrata.session import local_session

    session = local_session(os.environ.get("TEST_CPUS", "4"), shuffle_partitions=4, driver_memory="3g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
