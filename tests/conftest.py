import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from commitloom import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--conf spark.ui.showConsoleProgress=false pyspark-shell")
    spark = session.build("tests", 8, shuffle_partitions=2)
    spark.sparkContext.setLogLevel("ERROR")
    shared = tmp_path_factory.mktemp("shared")
    spark.sparkContext.setCheckpointDir(str(shared))
    yield spark
    session.clear(spark)
    assert not list(shared.glob("*/commitloom-*"))
