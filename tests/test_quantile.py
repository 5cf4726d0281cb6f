"""Exact quantiles equal Spark's ``percentile``, with forced brackets and steps too."""

import math
import random

import pytest
from pyspark.sql import functions as F

from riskframe.operators import quantile

PS = [0.0, 0.01, 0.05, 0.25, 0.5, 0.77, 0.95, 0.99, 1.0]
COLS = "abcdefh"


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    odd = [None, 1e300, -1e300, 1e-300, 0.5, float("inf"), float("-inf"), float("nan")]
    rows = [(k % 3 if k % 10 else None, rng.gauss(0, 1), rng.choice([0.0, 0.0, 0.0, 1.0, 5.0]), rng.choice(odd), None, 7.0, k,
             math.exp(rng.gauss(0, 40)) * rng.choice([-1, 1])) for k in range(3000)]
    schema = "g int, a double, b double, c double, d double, e double, f long, h double"
    return spark.createDataFrame(rows, schema).repartition(8).cache()


def _want(df, by):
    row = df.groupBy(*by).agg(*[F.struct(F.count(c).alias("n"), F.percentile(c, PS).alias("q")).alias(c) for c in COLS]).collect()
    return {(*[r[b] for b in by], c): (r[c]["n"], r[c]["q"]) for r in row for c in COLS}


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("sizes", [(4000, 64_000, 4096, 10 ** 6), (50, 60, 8, 0), (400, 500, 1, 0)])
def test_equals_percentile(table, monkeypatch, by, sizes):
    for name, value in zip(("ACCURACY", "SMALL", "STEPS", "WHOLE"), sizes):
        monkeypatch.setattr(quantile, name, value)
    rows = quantile.exact_quantiles(table, {c: F.col(c) for c in COLS}, PS, by).collect()
    got = {(*[r[b] for b in by], r["column"]): (r["n"], r["q"]) for r in rows}
    want = _want(table, by)
    assert len(rows) == len(want)
    # repr tells NaN and signs apart and makes NaN equal to NaN
    assert {k: repr(v) for k, v in got.items()} == {k: repr(v) for k, v in want.items()}


def test_empty_table_and_few_values(table):
    cols = {c: F.col(c) for c in COLS}
    empty = quantile.exact_quantiles(table.where("f < 0"), cols, PS).collect()
    assert sorted((r["column"], r["n"], r["q"]) for r in empty) == [(c, 0, None) for c in COLS]
    assert quantile.exact_quantiles(table.where("f < 0"), cols, PS, ["g"]).count() == 0
    for n in (1, 2, 3, 5):
        some = table.where(f"f < {n}")
        got = quantile.quantile_values(some, cols, PS)
        assert {c: repr(q) for c, q in got.items()} == {c: repr(q) for (c,), (_, q) in _want(some, []).items()}


def test_brackets_keep_most_values_out_of_the_shuffle(spark, monkeypatch):
    """What is ranked is a small share of the table, and no plan node is a ``percentile``."""
    monkeypatch.setattr(quantile, "ACCURACY", 1000)
    monkeypatch.setattr(quantile, "SMALL", 1000)
    monkeypatch.setattr(quantile, "WHOLE", 1000)
    df = spark.range(200_000).select((F.rand(5) * 1e6).alias("x"))
    found = quantile._brackets(df, [F.col("x")], [0.5], []).first()
    assert df.where(F.col("x").between(found["_lo"][0], found["_hi"][0])).count() < 0.02 * 200_000
    got = quantile.exact_quantiles(df, {"x": F.col("x")}, [0.5])
    assert "percentile(" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.first()["q"] == [df.agg(F.percentile("x", 0.5)).first()[0]]
