import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from adweave.session import get_session

    shared = tmp_path_factory.mktemp("shared")
    s = get_session(
        "tests",
        "local[4]",
        **{
            "spark.driver.memory": "4g",
            "spark.sql.shuffle.partitions": "4",
            "spark.checkpoint.dir": f"file://{shared}",
            "spark.sql.warehouse.dir": f"file://{shared}/warehouse",
            "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
