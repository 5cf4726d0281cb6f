"""Round trips of the sources and sinks, also onto the table being read."""

import datetime
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.sources import io

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("name", T.StringType()),
                       T.StructField("day", T.DateType()), T.StructField("flag", T.BooleanType())])
ROWS = [(1, 0.1 + 0.2, 'say "yes", no', datetime.date(2020, 2, 29), True), (2, None, None, None, None), (3, -1e-300, "", datetime.date(1999, 1, 1), False),
        (4, float("inf"), " kept ", None, True)]


@pytest.fixture
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def _rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_round_trip_onto_itself(spark, table, tmp_path, fmt):
    path = str(tmp_path / "deep" / "er" / "features")
    assert io.save_features(table, path, fmt) == path
    again = io.load_features(spark, path, SCHEMA if fmt == "csv" else None)
    # CSV has one sign for a null and an empty string
    rows = [(i, x, name or None, *r) if fmt == "csv" else (i, x, name, *r) for i, x, name, *r in sorted(ROWS)]
    assert [f.dataType for f in again.schema] == [f.dataType for f in SCHEMA] and _rows(again) == rows
    # the table that is read is replaced by what is computed from it
    io.save_features(again.where("id <> 2").withColumn("x", F.col("x") * 2), path, fmt)
    assert _rows(io.load_features(spark, path, SCHEMA)) == [(i, x * 2, *r) for i, x, *r in rows if i != 2]
    assert os.listdir(tmp_path / "deep" / "er") == ["features"]


def test_a_failed_job_leaves_the_old_table(spark, table, tmp_path):
    path = str(tmp_path / "t")
    io.save_features(table, path)
    bad = io.load_features(spark, path).withColumn("x", F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="no"):
        io.save_features(bad, path)
    assert _rows(io.load_features(spark, path)) == sorted(ROWS)
    assert os.listdir(tmp_path) == ["t"]


def test_dates_are_parsed_and_missing_paths_raise(spark, table, tmp_path):
    path = str(tmp_path / "d")
    io.save_features(table.select("id", F.date_format("day", "dd.MM.yyyy").alias("day")), path, "csv")
    got = io.load_features(spark, path, parse_dates=["day", "absent"], date_format="dd.MM.yyyy")
    assert got.schema["day"].dataType == T.DateType() and got.where("id = 1").first()["day"] == datetime.date(2020, 2, 29)
    with pytest.raises(AnalysisException):
        io.load_table(spark, str(tmp_path / "nowhere"))


def test_line_breaks_in_csv(spark, table, tmp_path):
    path = str(tmp_path / "lines")
    io.save_features(table.select("id", F.lit('one\ntwo "three"').alias("name")), path, "csv")
    got = io.load_table(spark, path, "csv", T.StructType([SCHEMA["id"], SCHEMA["name"]]), multi_line=True)
    assert {r["name"] for r in got.collect()} == {'one\ntwo "three"'} and got.count() == 4


def test_metrics_table_and_dataset(spark, tmp_path):
    metrics = spark.createDataFrame([("b", 0.5, {"0": 1}), ("a", 0.7, {"0": 2})], "model string, pr_auc double, confusion_matrix map<string,int>")
    path = io.save_metrics_table(io.metrics_csv_safe(metrics), str(tmp_path / "m"))
    got = io.load_table(spark, path, "csv")
    assert got.columns == ["model", "pr_auc"] and [r["model"] for r in got.collect()] == ["a", "b"]
    named = io.Dataset("loans", str(tmp_path / "loans"))
    named.save(metrics.drop("confusion_matrix"))
    named.load(spark)
    assert spark.sql("SELECT max(pr_auc) FROM loans").first()[0] == 0.7


def test_empty_table(spark, table, tmp_path):
    path = str(tmp_path / "e")
    io.save_features(table.where("id < 0"), path)
    assert io.load_features(spark, path).schema == SCHEMA and io.load_features(spark, path).count() == 0
