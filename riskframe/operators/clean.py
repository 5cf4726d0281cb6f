"""Cleaning operators (C1-C6).  Row-wise except the duplicate removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules


def rename_columns(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Rename by map; names not present are ignored."""
    mapping = rules.RENAME_MAP if mapping is None else mapping
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def serial_day_to_date(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Spreadsheet serial day number -> date (epoch 1899-12-30).

    Integral serials give a ``date``; fractional serials keep their time of day
    as a ``timestamp``.  Anything that does not parse becomes null.
    """
    columns = rules.DATE_COLUMNS if columns is None else columns
    epoch = F.lit(rules.SERIAL_DAY_EPOCH).cast("date")
    out = {}
    for c in columns:
        if c not in df.columns:
            continue
        dt = df.schema[c].dataType
        if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            continue
        if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
            seconds = F.try_multiply(F.col(c).cast("double"), F.lit(86400.0))
            out[c] = F.timestamp_seconds(
                F.unix_seconds(epoch.cast("timestamp")) + seconds.cast("bigint"))
        else:
            out[c] = F.date_add(epoch, F.expr(f"try_cast(`{c}` AS INT)"))
    return df.withColumns(out) if out else df


def standardize_missing(df: DataFrame, tokens: dict[str, list[str]] | None = None,
                        fill: str = rules.MISSING_FILL) -> DataFrame:
    """Null and the listed placeholder tokens -> ``Unknown``."""
    tokens = rules.MISSING_TOKENS if tokens is None else tokens
    out = {c: F.when(F.col(c).isNull() | F.col(c).isin(toks), F.lit(fill)).otherwise(F.col(c))
           for c, toks in tokens.items() if c in df.columns}
    return df.withColumns(out) if out else df


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """C4: remove rows equal in all columns (null equals null).

    Planned as a hash aggregate over all columns with a map-side partial
    step, so even a group of copies holding a large share of the table is
    collapsed in each map task before the shuffle.
    """
    return df.dropDuplicates()


def drop_noninformative_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop the fixed list where present."""
    columns = rules.NONINFORMATIVE_COLUMNS if columns is None else columns
    return df.drop(*[c for c in columns if c in df.columns])


def preprocess(df: DataFrame) -> DataFrame:
    """C1 -> C2 -> C3 -> C4 -> C5.  Dedup runs while the id is still present."""
    return (df.transform(rename_columns)
              .transform(serial_day_to_date)
              .transform(standardize_missing)
              .transform(drop_duplicate_rows)
              .transform(drop_noninformative_columns))
