import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bar_helpers import walk  # noqa: E402
from tickloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]", "tests",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def bars(spark):
    """Two series; A holds most of the rows."""
    pdf = pd.concat([walk(1500, 1, "A"), walk(300, 2, "B", "2024-03-01 05:00")], ignore_index=True)
    df = spark.createDataFrame(pdf).withColumn("ts", __import__("pyspark").sql.functions.col("ts").cast("timestamp_ntz"))
    return df.cache()
