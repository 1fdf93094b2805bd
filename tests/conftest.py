import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from marquee.session import SQL_DEFAULTS
    b = (SparkSession.builder.master("local[4]").appName("marquee-tests")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "8"))
    for k, v in SQL_DEFAULTS.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="marquee-test-ckpt-", dir="/tmp"))
    yield s


@pytest.fixture()
def tmpdir_run():
    return tempfile.mkdtemp(prefix="marquee-test-", dir="/tmp")
