import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from panelcast.session import local_session

    s = local_session(app="panelcast-tests", cores="*", shuffle_partitions=8)
    yield s


def panel_from_rows(spark, rows):
    """rows: (series_id, t, value) with t an int day offset; tiebreak = t."""
    import datetime as dt

    from pyspark.sql import types as T

    base = dt.datetime(2024, 1, 1)
    schema = T.StructType([
        T.StructField("series_id", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("tiebreak", T.LongType()),
        T.StructField("value", T.DoubleType()),
    ])
    data = [(s, base + dt.timedelta(days=t), int(t), None if v is None else float(v)) for s, t, v in rows]
    return spark.createDataFrame(data, schema)
