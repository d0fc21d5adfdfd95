import tempfile

import pytest
from pyspark.sql import SparkSession

from tidelake.session import SETTINGS

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    own = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp")}
    session = SparkSession.builder.master("local[8]").config(map=SETTINGS | own).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL
