from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from provenir.session import configure

    s = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield configure(s)
    s.stop()


def rows(df, *order):
    """Collected rows as dictionaries, sorted by the named columns."""
    got = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(got, key=lambda r: tuple(r[c] for c in order))
