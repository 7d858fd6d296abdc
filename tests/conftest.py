import os

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")

import pytest

from lattica.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", "tests", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="3g", spark__sql__execution__arrow__maxRecordsPerBatch="500")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
