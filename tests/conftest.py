import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from postmill.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate a single Column."""
    return lambda column: spark.range(1).select(column.alias("x")).first().x


@pytest.fixture
def evaluate(spark):
    """Apply a Column function to a list of texts, in order."""

    def run(texts, function):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        found = {r.i: r.v for r in rows.select("i", function("t").alias("v")).collect()}
        return [found[i] for i in range(len(texts))]

    return run
