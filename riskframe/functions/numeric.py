"""Numeric Column helpers (all JVM-side expressions, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def q6(c) -> Column:
    """Half-up rounding to 6 decimals: ``floor(x * 1e6 + 0.5) / 1e6``.

    Used on every computed double that leaves a query, so results do not
    depend on summation order (the oracle applies the same expression).
    """
    return round_to(c, 6)


def round_to(c, digits: int) -> Column:
    """Half-up rounding to ``digits`` decimals, same formula as :func:`q6`.

    ``floor`` gives a long, so values beyond its range (which have no such
    decimals) stay as they are; NaN becomes null.
    """
    s = float(10 ** digits)
    x = col_(c).cast("double")
    return F.when(F.abs(x) < F.lit(9e18 / s), F.floor(x * F.lit(s) + F.lit(0.5)) / F.lit(s)).when(~F.isnan(x), x)


def finite_or_null(c) -> Column:
    """NaN and +-inf become null (Spark treats NaN as a value, not missing)."""
    c = col_(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def safe_divide(num, den, min_den: float = 0.0) -> Column:
    """num / den when den is not null and |den| > min_den, else null (F1)."""
    num, den = col_(num), col_(den)
    return F.when(den.isNotNull() & (F.abs(den) > F.lit(min_den)),
                  F.try_divide(num.cast("double"), den.cast("double")))


def is_numeric(dt: T.DataType, include_bool: bool = True) -> bool:
    return isinstance(dt, NUMERIC_TYPES) or (include_bool and isinstance(dt, T.BooleanType))


def numeric_columns(df: DataFrame, exclude=(), include_bool: bool = True) -> list[str]:
    return [f.name for f in df.schema.fields
            if is_numeric(f.dataType, include_bool) and f.name not in set(exclude)]


def categorical_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in set(exclude)]


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Apply :func:`round_to` to every double/float column (report output)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round_to(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
