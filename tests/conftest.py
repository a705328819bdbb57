import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark.session import session

    shared = tmp_path_factory.mktemp("shared")
    s = session("local[8]", 4, spark_driver_memory="4g", spark_checkpoint_dir=f"file://{shared}", spark_ui_showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
