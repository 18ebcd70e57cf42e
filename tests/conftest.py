import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ.setdefault("PYTHONPATH", str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lectern.session import build_session

    session = build_session(
        "lectern-tests",
        master="local[8]",
        shuffle_partitions=8,
        extra={"spark.checkpoint.dir": str(tmp_path_factory.mktemp("ckpt")), "spark.driver.memory": "8g"},
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
