"""F tail probabilities against closed forms; correlations of columns with large means; copies of hot rows."""

import math
from decimal import Decimal, getcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import profile
from riskframe.operators.separation import f_survival

DF2 = [1, 2, 3, 7, 40, 1e3, 1e6, 1e9, 1e12]


@pytest.mark.parametrize("f", [1e-6, 0.02, 0.5, 0.999, 1.0, 1.001, 2.0, 5.0, 30.0])
def test_f_tail_closed_forms(f):
    getcontext().prec = 60
    for d2 in DF2:
        x, y = Decimal(d2), Decimal(f)
        two = (1 + 2 * y / x) ** (-x / 2)  # two degrees of freedom above
        four = (1 + 4 * y / x) ** (-x / 2) * (1 + x / 2 * (4 * y / x) / (1 + 4 * y / x))  # and four
        assert f_survival(f, 2, d2)[0] == pytest.approx(float(two), rel=1e-10)
        assert f_survival(f, 4, d2)[0] == pytest.approx(float(four), rel=1e-10)
        below = 1 - (1 + x * 0 + Decimal(2) / (Decimal(d2) * y)) ** (-x / 2)  # two degrees below
        assert f_survival(f, d2, 2)[0] == pytest.approx(float(below), rel=1e-10, abs=1e-14)
    assert f_survival(f, 1, 1)[0] == pytest.approx(2 / math.pi * math.atan(1 / math.sqrt(f)), rel=1e-12)
    # one degree and very many: the square of a normal variable
    assert f_survival(f, 1, 1e12)[0] == pytest.approx(math.erfc(math.sqrt(f / 2)), rel=1e-9)


def test_f_tail_ends_and_symmetry():
    assert f_survival([0.0, math.inf], 3, 50).tolist() == [1.0, 0.0]
    for d1, d2 in ((3, 1e7), (1e5, 1e6), (2.5, 0.7)):
        assert f_survival(1.3, d1, d2)[0] + f_survival(1 / 1.3, d2, d1)[0] == pytest.approx(1.0, rel=1e-12)
    assert f_survival(1.0, 1e6, 1e6)[0] == pytest.approx(0.5, rel=1e-9)


def test_correlation_of_large_means_nulls_and_constants(spark):
    rng = np.random.default_rng(4)
    n = 4000
    noise, other = rng.normal(size=n), rng.normal(size=n)
    rows = [(float(1e9 + noise[k]), float(2e9 - noise[k] + 0.5 * other[k]), 7.1 if k % 3 else None, float(other[k]) if k % 5 else None, None, 1e300 if k else -1.0)
            for k in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, big double").repartition(7)
    got = {(r[0], r[1]): r for r in profile._pair_table(df, [("a", "b"), ("a", "c"), ("a", "d"), ("d", "e"), ("b", "d"), ("a", "a")]).collect()}
    a, b = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    keep = np.arange(n) % 5 != 0
    assert got["a", "b"]["r"] == pytest.approx(np.corrcoef(a - 1e9, b - 2e9)[0, 1], abs=1e-9)
    assert got["b", "d"]["r"] == pytest.approx(np.corrcoef(b[keep] - 2e9, other[keep])[0, 1], abs=1e-9)
    assert got["a", "a"]["r"] == pytest.approx(1.0, abs=1e-12)
    assert got["a", "c"]["r"] is None and got["a", "c"]["spread_2"] == 0.0
    assert got["d", "e"]["r"] is None and got["d", "e"]["spread_2"] is None
    # the same on exact numbers
    getcontext().prec = 50
    xa, xb = [Decimal(v) for v in a.tolist()], [Decimal(v) for v in b.tolist()]
    ma, mb = sum(xa) / n, sum(xb) / n
    cov, va, vb = (sum(p * q for p, q in zip(u, v)) for u, v in (([x - ma for x in xa], [x - mb for x in xb]), ([x - ma for x in xa],) * 2, ([x - mb for x in xb],) * 2))
    assert got["a", "b"]["r"] == pytest.approx(float(cov / (va * vb).sqrt()), abs=1e-12)


def test_correlation_of_empty_table(spark):
    df = spark.createDataFrame([], "a double, b double, y int")
    assert [tuple(r) for r in profile._pair_table(df, [("a", "b")]).collect()] == [("a", "b", None, None, None)]
    assert profile.correlated_pairs_with_target(df, "y").count() == 0


def test_duplicated_rows_of_a_hot_row(spark, monkeypatch):
    """A row repeated very often is listed block by block, in many tasks."""
    monkeypatch.setattr(profile, "COPY_BLOCK", 1000)
    df = spark.range(50_000).select(F.lit("hot").alias("x"), F.lit(None).cast("int").alias("y"))
    df = df.unionByName(spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("hot", 1)], "x string, y int"))
    out = profile.duplicated_rows(df)
    assert {tuple(r) for r in out.groupBy("x", "y").count().collect()} == {("hot", None, 49_999), ("a", 1, 1)}
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 30_000
    by_x = profile.duplicated_rows(df, ["x"])
    assert {tuple(r) for r in by_x.groupBy("x", "y").count().collect()} == {("hot", None, 49_999), ("hot", 1, 1), ("a", 1, 1)}
