"""Vendor files: one partition per file, filters that choose files and rows, edge files."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from panelcast.sources.panel import events_by_type
from panelcast.sources.vendor import PUSHDOWN, read_vendor_files, write_vendor_files


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vendor") / "files")
    write_vendor_files(events_by_type(spark, SF_SMALL), path)
    return path


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_all_files_are_the_panel(spark, folder):
    panel = events_by_type(spark, SF_SMALL)
    got = read_vendor_files(spark, folder)
    assert _rows(got) == _rows(panel.select(*got.columns))
    assert got.rdd.getNumPartitions() == panel.select("series_id").distinct().count()


def test_arguments_choose_files_and_rows(spark, folder):
    panel = events_by_type(spark, SF_SMALL)
    middle = panel.agg(F.percentile_approx("ts", 0.5)).first()[0]
    got = read_vendor_files(spark, folder, series=["click", "view"], since=middle)
    assert got.rdd.getNumPartitions() == 2
    assert _rows(got) == _rows(panel.where(F.col("series_id").isin("click", "view") & (F.col("ts") >= F.lit(middle))).select(*got.columns))
    assert read_vendor_files(spark, folder, series=["none"]).collect() == []


def test_filters_of_the_query_are_pushed(spark, folder):
    before = spark.conf.get(PUSHDOWN, "false")
    spark.conf.set(PUSHDOWN, "true")
    try:
        panel = events_by_type(spark, SF_SMALL)
        middle = panel.agg(F.percentile_approx("ts", 0.5)).first()[0]
        some = lambda d: d.where((F.col("series_id") == "click") & (F.col("ts") > F.lit(middle)) & (F.col("value") > 0))
        got = some(read_vendor_files(spark, folder))
        assert got.rdd.getNumPartitions() == 1
        plan = got._jdf.queryExecution().executedPlan().toString()
        # what the source takes over is no longer filtered above it
        assert "BatchScan vendor_files" in plan and "= click" not in plan and "> 0.0" in plan and "(ts#" not in plan.split("BatchScan")[0].replace("isnotnull(ts#", "")
        assert _rows(got) == _rows(some(panel).select(*got.columns))
    finally:
        spark.conf.set(PUSHDOWN, before)


def test_edge_files(spark, tmp_path):
    (tmp_path / "AAPL.csv").write_text("Date,Open,Close\n01/02/2020,1,10.5\n,2,11\n01/03/2020,3,\n")
    (tmp_path / "EMPTY.csv").write_text("")
    (tmp_path / "HEAD.csv").write_text("Date,Close\n")
    (tmp_path / "notes.txt").write_text("not a vendor file")
    got = read_vendor_files(spark, str(tmp_path), fmt="%m/%d/%Y").collect()
    assert sorted(map(tuple, got), key=str) == [("AAPL", dt.datetime(2020, 1, 2), 0, 10.5), ("AAPL", dt.datetime(2020, 1, 3), 2, None)]
    assert read_vendor_files(spark, str(tmp_path / "missing")).collect() == []
    with pytest.raises(Exception, match="CSV conversion error"):
        read_vendor_files(spark, str(tmp_path)).collect()


def test_many_files_share_partitions(spark, tmp_path):
    for i in range(900):
        (tmp_path / f"T{i:03}.csv").write_text(f"Date,Close\n2020-01-01,{i}\n2020-01-02,\n")
    (tmp_path / "LONG.csv").write_text("Date,Close\n" + "".join(f"2020-01-{1 + i % 28:02},{i}\n" for i in range(100_000)))
    got = read_vendor_files(spark, str(tmp_path))
    assert 100 < got.rdd.getNumPartitions() <= 500
    want = [(f"T{i:03}", dt.datetime(2020, 1, d + 1), d, v) for i in range(900) for d, v in enumerate((float(i), None))]
    assert sorted(map(tuple, got.where("series_id <> 'LONG'").collect()), key=lambda r: r[:3]) == want
    assert got.where("series_id = 'LONG'").agg(F.count("value"), F.max("tiebreak"), F.sum("value")).first() == (100_000, 99_999, 4_999_950_000.0)
