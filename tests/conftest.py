import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pelorus import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("checkpoints"))
    s = session.build("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": folder + "/warehouse"})
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(folder)
    yield s
    s.stop()
