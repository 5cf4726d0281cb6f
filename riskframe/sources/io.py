"""Table sources and sinks."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NESTED_METRIC_COLUMNS = ["confusion_matrix", "classification_report"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table: ``<sf_dir>/<name>.parquet``."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _folder(spark: SparkSession, path: str):
    """(file system, Hadoop path): files are looked at where Spark reads them, not on the driver's disk."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _format_of(spark: SparkSession, path: str) -> str:
    """``csv`` for a file of that name or a folder that holds any, else ``parquet``."""
    if path.endswith(".csv"):
        return "csv"
    fs, at = _folder(spark, path)
    jvm = spark.sparkContext._jvm
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(at, "*.csv*"))
    return "csv" if found is not None and len(found) else "parquet"


def _read_csv(spark: SparkSession, path: str, schema: T.StructType | None, date_format: str | None = None, multi_line: bool = False) -> DataFrame:
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    if date_format is not None:
        reader = reader.option("dateFormat", date_format)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def load_table(spark: SparkSession, path: str, fmt: str | None = None,
               schema: T.StructType | None = None, multi_line: bool = False) -> DataFrame:
    """Whole-table read; a missing path raises (AnalysisException).

    ``multi_line`` reads CSV values that hold line breaks; a file is then one task.
    """
    fmt = fmt or ("csv" if path.endswith(".csv") else "parquet")
    if fmt == "csv":
        return _read_csv(spark, path, schema, multi_line=multi_line)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.format(fmt).load(path)


def load_features(spark: SparkSession, path: str, schema: T.StructType | None = None,
                  parse_dates: list[str] | None = None, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Feature table with header; listed columns parsed as dates.

    Parquet keeps its schema; CSV takes the given schema (no inference when
    one is supplied, which is what a production job should do).
    """
    df = _read_csv(spark, path, schema, date_format) if _format_of(spark, path) == "csv" else spark.read.parquet(path)
    for c in parse_dates or []:
        if c in df.columns and not isinstance(df.schema[c].dataType, T.DateType):
            df = df.withColumn(c, F.to_date(F.col(c), date_format))
    return df


def _replace(df: DataFrame, path: str, fmt: str) -> str:
    """Write beside ``path``, then put the new table in the old one's place.

    The old table is read until the new one is complete, so a table may be
    replaced by what is computed from it, and a failed job leaves it as it
    was.  The swap is two renames: quick on a file system, a copy on a plain object store.
    """
    spark = df.sparkSession
    fs, at = _folder(spark, path)
    name = lambda what: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{what}-{uuid.uuid4().hex}")
    staged, old = name("new"), name("old")
    writer = df.write
    if fmt == "csv":
        writer = writer.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    try:
        writer.format(fmt).save(staged.toString())
        if fs.exists(at) and not fs.rename(at, old):
            raise OSError(f"{path} can't be moved aside")
        if at.getParent() is not None:
            fs.mkdirs(at.getParent())
        if not fs.rename(staged, at):
            if fs.exists(old):
                fs.rename(old, at)
            raise OSError(f"{path} can't be replaced")
    except Exception:
        fs.delete(staged, True)
        raise
    fs.delete(old, True)
    return path


def save_features(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """S3: the table at ``path`` is replaced (also by what is computed from it), parents created, header row for CSV.

    CSV doesn't tell a null from an empty string: both are read back as null.
    """
    return _replace(df, path, fmt)


def metrics_csv_safe(df: DataFrame, sort_by: str = "pr_auc") -> DataFrame:
    """Drop nested metric columns, order by ``sort_by`` desc when present."""
    out = df.drop(*[c for c in NESTED_METRIC_COLUMNS if c in df.columns])
    if sort_by in out.columns:
        out = out.orderBy(F.col(sort_by).desc_nulls_last())
    return out


def save_metrics_table(df: DataFrame, path: str) -> str:
    """One result table as CSV with header (nested columns dropped); a small result is one file, a large one several in order."""
    return _replace(metrics_csv_safe(df, sort_by="__none__"), path, "csv")


@dataclass(frozen=True)
class Dataset:
    """A named table with a path and an optional fixed schema."""

    name: str
    path: str
    schema: T.StructType | None = None
    fmt: str = "parquet"

    def load(self, spark: SparkSession) -> DataFrame:
        df = load_table(spark, self.path, self.fmt, self.schema)
        df.createOrReplaceTempView(self.name)
        return df

    def save(self, df: DataFrame) -> str:
        return save_features(df, self.path, self.fmt)
