import tempfile

import pytest
from pyspark.sql import SparkSession

from notelake.session import ship


@pytest.fixture(scope="session")
def spark():
    root = tempfile.mkdtemp(prefix="notelake-tests-")
    conf = {
        "spark.sql.shuffle.partitions": "3", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": f"{root}/shared", "spark.sql.warehouse.dir": f"{root}/warehouse", "spark.ui.showConsoleProgress": "false",
    }
    session = ship(SparkSession.builder.master("local[4]").config(map=conf).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
