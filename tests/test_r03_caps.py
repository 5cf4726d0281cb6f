"""The capped scale: quartiles of the clipped column, asked for again only where clipping may move them."""

import pytest
from pyspark.sql import functions as F

from riskframe.operators import prep


@pytest.mark.parametrize("n, cap", [(3, (0.01, 0.99)), (2000, (0.01, 0.99)), (2000, (0.3, 0.6))])
def test_capped_scales_are_those_of_the_clipped_column(spark, monkeypatch, n, cap):
    asked = []
    real = prep.quantile_values
    monkeypatch.setattr(prep, "quantile_values", lambda df, xs, *a: asked.append(list(xs)) or real(df, xs, *a))
    x = F.rand(3) ** 4 * 1e4
    df = spark.range(n).select(x.alias("full"), F.when(F.col("id") % 5 > 0, x).alias("gaps"), F.lit(None).cast("double").alias("none")).checkpoint()
    got = prep.MedianImputeRobustScale(["full", "gaps", "none"], cap=cap).fit(df)
    q = df.agg(*[F.percentile(c, [0.5, *cap]).alias(c) for c in df.columns]).first()
    for c in df.columns:
        v = F.coalesce(c, F.lit((q[c] or [0.0])[0]))
        v = F.least(F.greatest(v, F.lit(q[c][1])), F.lit(q[c][2])) if q[c] else v
        assert got.stats[c] == tuple(df.agg(F.percentile(v, [0.5, 0.25, 0.75])).first()[0])
    assert ("full" in asked[-1]) == (n == 3 or cap == (0.3, 0.6))
