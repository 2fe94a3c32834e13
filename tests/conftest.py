import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from fleetpulse.session import DEFAULT_CONF
    b = SparkSession.builder.master("local[*]").appName("fleetpulse-tests")
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    s = (b.config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    # Only tests set their own checkpoint folder, and only when none is configured.
    if not s.sparkContext.getCheckpointDir() and not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fleetpulse-ckpt-"))
    yield s


@pytest.fixture
def tmp_dir():
    return tempfile.mkdtemp(prefix="fleetpulse-test-")
