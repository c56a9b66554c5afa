"""K01/K02/K04 and versioned writes."""

import os

import pytest
from pyspark.errors import AnalysisException

from touchline.sources import sinks as K


def test_write_staging_adds_audit_columns_and_appends(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "fixture_id int")
    path = str(tmp_path / "stg")
    K.write_staging(df, path, as_of="2024-01-01 00:00:00")
    K.write_staging(df, path, mode="append", as_of="2024-01-02 00:00:00")
    out = spark.read.parquet(path)
    assert set(out.columns) == {"fixture_id", "is_valid", "error_reason", "load_timestamp"}
    assert out.count() == 4 and out.where("is_valid").count() == 4
    K.write_staging(df, path, as_of="2024-01-03 00:00:00")  # truncate-and-load
    assert spark.read.parquet(path).count() == 2


def test_write_snapshot_modes(spark, tmp_path):
    path = str(tmp_path / "snap")
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(2,), (3,)], "x int")
    K.write_snapshot(a, path, "skip")
    K.write_snapshot(b, path, "skip")            # present: left untouched
    assert spark.read.json(path).count() == 1
    with pytest.raises(AnalysisException):
        K.write_snapshot(b, path, "error")
    K.write_snapshot(b, path, "overwrite")
    assert spark.read.json(path).count() == 2


def test_write_version_never_reuses_a_folder(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "x int")
    p1, p2 = K.write_version(df, str(tmp_path / "t")), K.write_version(df, str(tmp_path / "t"))
    assert p1 != p2 and os.path.isdir(p1) and os.path.isdir(p2)
