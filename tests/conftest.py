import os
import signal
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


#: Seconds that one test may take, its fixtures aside.
LIMIT = int(os.environ.get("TEST_LIMIT", "600"))


@pytest.hookimpl(wrapper=True)
def pytest_runtest_call(item):
    def stop(*_):
        raise TimeoutError(f"{item.name} took more than {LIMIT} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.alarm(LIMIT)
    try:
        return (yield)
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)
