import os
import tempfile

import pytest

os.environ.setdefault("OMP_NUM_THREADS", "2")  # before numpy: Spark's threads use the cores

from tickloom.session import session


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="spark-test-")
    s = session("tests", spark__master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g", spark__ui__showConsoleProgress="false", spark__local__dir=scratch, spark__checkpoint__dir=f"{scratch}/shared", spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
