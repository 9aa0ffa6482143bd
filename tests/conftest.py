import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from millrace.session import build

    session = build("local[4]", 4, **{"spark.driver.memory": "4g", "spark.sql.autoBroadcastJoinThreshold": "256k"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
