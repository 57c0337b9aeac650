import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def pytest_addoption(parser):
    parser.addoption("--every", action="store_true", help="run the dear queries as well")


def pytest_configure(config):
    config.addinivalue_line("markers", "dear: takes long, and runs with --every only")


def pytest_collection_modifyitems(config, items):
    if not config.getoption("--every"):
        for item in items:
            if "dear" in item.keywords:
                item.add_marker(pytest.mark.skip(reason="runs with --every"))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
