"""Round 3: tables that several passes read are written once; brackets placed by some rows stay exact."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import clusterers, quantile, split, train
from riskframe.plans import catalog
from riskframe.session import staged


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("source", [catalog.split_loans, catalog.labelled_features, catalog.unlabelled_features, catalog._seg,
                                    catalog.model_table, catalog.model_table_unlabelled])
def test_the_loan_chain_is_not_read_again(spark, source):
    plan = _plan(source(spark, "/root/testdata/sf0.001"))
    assert "staged-" in plan and "lineitem" not in plan and "l_orderkey" not in plan


def test_split_reads_its_rows_once(spark):
    rows = staged(spark.range(2000).select(F.col("id"), (F.col("id") % 3).alias("y")))
    assert _plan(split.stratified_split(rows, "y", "id")).count("FileScan") == 1


def test_staged_keeps_rows_and_null_columns(spark):
    rows = spark.createDataFrame([(1, None, float("nan")), (1, "a b", -0.0), (None, "", None)], "`a b` int, s string, d double")
    assert sorted(map(repr, staged(rows).collect())) == sorted(map(repr, rows.collect()))
    assert staged(rows.withColumn("n", F.lit(None))).count() == 3
    assert staged(rows.where("false")).count() == 0


@pytest.mark.parametrize("placing", [500, 20_000])
def test_brackets_from_some_rows_are_exact(spark, monkeypatch, placing):
    for name, value in (("SMALL", 200), ("ACCURACY", 200), ("STEPS", 16), ("WHOLE", 1000), ("PLACING", placing)):
        monkeypatch.setattr(quantile, name, value)
    x = F.rand(5) * 1e6
    df = spark.range(40_000).select(x.alias("x"), F.when(F.col("id") % 100 == 7, x).alias("sparse"), (F.col("id") % 3).cast("double").alias("few"),
                                    F.when(F.col("id") % 2 == 0, float("nan")).when(F.col("id") % 10 == 1, F.lit(None)).otherwise(x).alias("nan")).localCheckpoint()
    ps = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = quantile.quantile_values(df, {c: F.col(c) for c in df.columns}, ps)
    want = df.agg(*[F.percentile(c, ps).alias(c) for c in df.columns]).first().asDict()
    assert repr(got) == repr(want)
    # no row of the table is exploded into its columns, whatever their number
    assert "Generate" not in _plan(quantile._cell_counts(df, [F.col("x")], quantile._placed(df, [F.col("x")], ps, 40_000)))


def test_mixture_pass_equals_the_sums_by_component(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4)) + [0, 5, 1e6, 0]
    fit = clusterers.Mixture(np.array([.3, .7]), x[:2].copy(), np.array([[1, 2, 3, 1e-6], [2, 1, 1, 1.]]))
    want = np.stack([np.log(w) - .5 * np.log(2 * np.pi * v).sum() - .5 * ((x - m) ** 2 / v).sum(axis=1)
                     for w, m, v in zip(fit.weights, fit.means, fit.variances)], axis=1)
    assert fit.log_densities(x) == pytest.approx(want, rel=1e-8)
    rows = spark.createDataFrame([([float(a) for a in p],) for p in x], "x array<double>")
    total = clusterers._mixture_pass(clusterers.blocks(rows, "x"), {0: fit}, hard=False)
    top = want.max(axis=1, keepdims=True)
    r = np.exp(want - top) / np.exp(want - top).sum(axis=1, keepdims=True)
    for j in (0, 1):
        diff = x - fit.means[j]
        assert total[0, j][2:6] == pytest.approx(r[:, j] @ diff, abs=1e-5)
        assert total[0, j][6:] == pytest.approx(r[:, j] @ diff ** 2, rel=1e-6, abs=1e-4)


def test_scores_are_written_once(spark, monkeypatch):
    from pyspark.ml.classification import DecisionTreeClassifier
    monkeypatch.setattr(train, "candidate_models", lambda weights, seed: {
        "tree": DecisionTreeClassifier(featuresCol="features", labelCol="y", weightCol="weight", maxDepth=2)})
    rows = spark.range(400).select(F.col("id"), (F.col("id") % 7).cast("double").alias("loan_to_value"),
                                   F.lit("ab").substr(F.col("id").cast("int") % 2 + 1, F.lit(1)).alias("c"), (F.col("id") % 4 == 0).cast("int").alias("t"))
    run = train.train_all_models(rows, "t", "id")
    assert "staged-" in _plan(run.scored) and run.scored.count() == 80
