import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from weftspark.session import get_session

    shared = tmp_path_factory.mktemp("shared")
    session = get_session(
        "tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.checkpoint.dir": f"file://{shared}",
            "spark.driver.memory": "6g",
            "spark.sql.warehouse.dir": f"file://{tmp_path_factory.mktemp('warehouse')}",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    return session
