import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from dictalog.session import build_session

    s = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def small_slices(spark):
    """Make every source with more than a few rows count as hot."""
    from dictalog.operators.slices import MAX_ROWS_CONF

    spark.conf.set(MAX_ROWS_CONF, "6")
    yield
    spark.conf.unset(MAX_ROWS_CONF)
