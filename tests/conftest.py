import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from housemark.session import build_session  # noqa: E402
from housemark.sources.scratch import new_path  # noqa: E402
from housemark.sources.tables import TableStore  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        {
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def store(spark):
    return TableStore(spark, new_path(spark, "store"))


@pytest.fixture
def path(spark):
    return new_path(spark, "path")
