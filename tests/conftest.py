import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from flowtrace.session import SESSION_DEFAULTS, ensure_checkpoint_dir

    builder = (SparkSession.builder.master("local[4]").appName("flowtrace-tests")
               .config("spark.sql.shuffle.partitions", "8"))
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    # Tests set their own checkpoint folder only when the session has none.
    if not session.sparkContext.getCheckpointDir() and not session.conf.get(
            "spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ft-test-ckpt-"))
    ensure_checkpoint_dir(session)
    yield session


@pytest.fixture(scope="session")
def scratch():
    return tempfile.mkdtemp(prefix="ft-test-")
