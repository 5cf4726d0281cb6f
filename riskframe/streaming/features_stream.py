"""Row-wise cleaning and feature projection on a streaming source.

The feature operators are row-wise, so the same Column expressions run on a
stream.  Duplicate removal needs state: it uses
``dropDuplicatesWithinWatermark`` on an event-time column, and the reference
date (F3) must be given, since a stream has no global minimum.
"""

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean, features


def stream_features(stream: DataFrame, reference_date: _dt.date, event_time: str,
                    watermark: str = "1 day") -> DataFrame:
    """C1-C3, C4 within the watermark, C5 and F2-F17 on a streaming DataFrame (event time kept)."""
    df = (stream.transform(clean.rename_columns).transform(clean.serial_day_to_date)
          .transform(clean.standardize_missing))
    df = df.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(
        [c for c in df.columns if c != event_time])
    df = clean.drop_noninformative_columns(df)
    out = features.FeatureModel(reference_date).transform(df)
    return out.withColumn(event_time, F.col(event_time))
