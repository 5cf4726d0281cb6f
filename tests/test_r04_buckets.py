"""Score buckets: the place among ascending bounds, found in two steps."""

import pytest
from pyspark.sql import functions as F

from riskframe.operators import evaluate


@pytest.mark.parametrize("size", [1, 15, 16, 17, 255, 256])
def test_two_steps_find_the_place_among_the_bounds(spark, size):
    bounds = F.array(*[F.lit(float(i // 3)) for i in range(size)])
    score = F.when(F.col("id") == 0, F.lit(None).cast("double")).when(F.col("id") == 1, F.lit(float("nan"))).otherwise(F.col("id") / 2 - 3)
    rows = spark.range(200).select(bounds.alias("b"), score.alias("s")).withColumn("c", F.filter("b", lambda v, i: i % 16 == 15))
    got = rows.select(evaluate._below(F.col("b"), F.col("c"), F.col("s")).alias("got"), F.size(F.filter("b", lambda v: v < F.col("s"))).alias("want")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
