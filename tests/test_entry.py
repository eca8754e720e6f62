"""Driver contract and a DuckDB oracle pass at the smallest scale."""
import math
import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["series_id", "horizon", "split", "n", "rmse", "r2"]


def test_oracle_keys_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


SPARK_TO_DUCKDB = {"string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "bigint": "BIGINT", "int": "INTEGER",
                   "double": "DOUBLE"}


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    rel = con.sql(E.oracle_sql()[name])
    assert {k: SPARK_TO_DUCKDB.get(v) for k, v in df.dtypes} == dict(zip(rel.columns, map(str, rel.types)))
    sdf = df.toPandas()
    ddf = rel.df()
    sc, sr = _rows(sdf)
    dc, dr = _rows(ddf)
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr


def test_queries_without_the_training_data_operators(tmp_path):
    root = os.path.dirname(os.path.abspath(E.__file__))
    skip = lambda folder, names: {n for n in names if n in ("llm", ".git", "__pycache__")}
    shutil.copytree(root, tmp_path / "copy", ignore=skip)
    code = "import __spark_entry__ as E; q = E.queries(); print(len(q), set(E.oracle_sql()) <= set(q), [n for n in q if n[:2] == 'op' or n == 'pipeline'])"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, check=True)
    own = [n for n in E.queries() if not (n.startswith("op") and n[2].isdigit()) and n != "pipeline"]
    assert done.stdout.split(maxsplit=1) == [str(len(own)), "True []\n"]


ROWS_ONLY = sorted(n for n in set(E.queries()) - set(E.oracle_sql()) if n.startswith(("forecast_", "stationarity_")))


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_queries_run(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = df.collect()
    assert len(rows) > 0
    if name.startswith("forecast_"):
        assert {"series_id", "ts", "split", "DeltaZ1", "forecast_1day", "actual_1day"} <= set(df.columns)
        assert all(r["forecast_1day"] is not None for r in rows)
    else:
        assert {"series_id", "stat", "p_value"} <= set(df.columns)
