import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from symptia.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def texts(spark):
    def make(*values):
        return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, text string")

    return make


@pytest.fixture
def column(texts):
    """The values of an expression over some texts, in order."""

    def evaluate(expression, *values):
        return [r.v for r in texts(*values).select("id", expression.alias("v")).orderBy("id").collect()]

    return evaluate
