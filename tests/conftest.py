import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import build_session

    session = build_session(
        "tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def people(spark):
    rows = [
        (1, "Alice", 25, 50000.0, "HR"),
        (2, "Bob", 30, 60000.0, "IT"),
        (3, "Charlie", 35, None, "Finance"),
        (4, "David", 100, 80000.0, "IT"),
        (1, "Alice", 25, 50000.0, "HR"),
    ]
    return spark.createDataFrame(rows, "id int, name string, age int, salary double, department string")


@pytest.fixture(scope="session")
def bonus(spark):
    return spark.createDataFrame([(1, 5000), (2, 6000), (3, 7000)], "id int, bonus int")
