"""Quantiles without groups: two scans beside the row count."""

from pyspark.sql import functions as F

from riskframe.operators import quantile


def test_brackets_take_one_scan_to_place_and_one_to_count(spark, monkeypatch):
    for name, value in (("SMALL", 200), ("ACCURACY", 200), ("STEPS", 16), ("WHOLE", 1000), ("PLACING", 2000)):
        monkeypatch.setattr(quantile, name, value)
    scans = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            scans.add(batch.num_rows)
            yield batch
    x = F.rand(5) * 1e6
    rows = spark.range(20_000).select(x.alias("x"), F.when(F.col("id") % 400 == 7, x).alias("sparse"), F.lit(None).cast("double").alias("none"),
                                      F.when(F.col("id") % 3 == 0, float("nan")).otherwise(x).alias("nan"), (-F.col("id") % 3).cast("double").alias("few")).checkpoint()
    df, ps = rows.mapInArrow(counted, rows.schema), [0.0, 0.01, 0.5, 1.0]
    got = quantile.quantile_values(df, {c: F.col(c) for c in df.columns}, ps)
    # the row count, the placing and the counting of cells
    assert scans.value == 3 * 20_000
    want = rows.agg(*[F.percentile(c, ps).alias(c) for c in df.columns]).first().asDict()
    assert repr(got) == repr(want)
