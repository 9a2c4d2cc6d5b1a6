import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from fanlens.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session(4, shuffle_partitions=4, app="fanlens-tests")
    yield s


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


@pytest.fixture
def make_log(spark):
    """Interaction log from (uid, entity, 'YYYY-MM-DD HH:MM:SS[.ffffff]') tuples."""
    from pyspark.sql import functions as F

    from fanlens.sources.interactions import conform

    def make(rows):
        df = spark.createDataFrame([(u, e, t) for u, e, t in rows], "uid long, entity long, t string")
        return conform(df.select("uid", "entity", F.col("t").cast("timestamp_ntz").alias("ts")))

    return make
