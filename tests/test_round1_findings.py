"""Rounding beyond the range of a long, NaN, null duplicate keys, out-of-fold means of single-fold categories."""

import math

import pytest

from riskframe.functions.numeric import q6, round_to
from riskframe.operators.prep import TargetEncoder
from riskframe.operators.profile import duplicated_rows


def test_rounding_keeps_large_values_and_drops_nan(spark):
    df = spark.createDataFrame([(1e13 + 0.5,), (-3e15,), (float("nan"),), (1.23456789,), (None,)], "x double")
    got = [r[0] for r in df.select(round_to("x", 6)).collect()]
    assert got[:2] == [1e13 + 0.5, -3e15] and got[2] is None and math.isclose(got[3], 1.234568) and got[4] is None
    assert df.select(q6("x")).first()[0] == 1e13 + 0.5


def test_duplicates_with_null_keys(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b"), (1, "c"), (1, "d")], "k int, v string")
    assert {(r.k, r.v) for r in duplicated_rows(df, ["k"]).collect()} == {(None, "b"), (1, "d")}


def test_category_of_one_fold_gets_the_mean_of_the_others(spark):
    rows = [(i, "rare" if i == 0 else f"c{i % 3}", float(i % 2)) for i in range(41)]
    df = spark.createDataFrame(rows, "id long, c string, y double")
    model = TargetEncoder("c", "y", "id").fit(df)
    rare = model.oof.where("value = 'rare'").collect()
    assert len(rare) == 5
    own = [r for r in rare if r["enc"] is not None]
    assert len(own) == 5 and any(abs(r["enc"] - sum(y for _, _, y in rows) / 41) > 1e-6 for r in own)
    with pytest.raises(StopIteration):
        next(r for r in rare if not 0 <= r["enc"] <= 1)
