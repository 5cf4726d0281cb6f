"""The preparation pipeline: saved and loaded it gives the same features and scores."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import SMALL
from riskframe.operators import pipeline, prep, split, train
from riskframe.plans import catalog


@pytest.fixture(scope="module")
def loans(spark):
    s = catalog.split_loans(spark, SMALL).checkpoint()
    tr = split.assign_folds(split.balanced_weights(s.where(~F.col("is_test")), "target"), "target", "unique_id", 5, 2).checkpoint()
    return tr, s.where(F.col("is_test"))


def _features(model, rows):
    out = model.transform(rows).select("unique_id", vector_to_array("features").alias("x")).collect()
    return {r["unique_id"]: list(r["x"]) for r in out}


def test_saved_pipeline_gives_equal_features_and_scores(spark, loans, tmp_path):
    tr, te = loans
    classifier = LogisticRegression(featuresCol="features", labelCol="target", weightCol="weight", maxIter=20)
    model = pipeline.preparation_pipeline(tr, "target", "unique_id", classifier).fit(tr)
    path = pipeline.save_pipeline(model, str(tmp_path / "model"))
    pipeline.save_pipeline(model, path)  # replaced, not an error
    again = pipeline.load_pipeline(spark, path)
    assert isinstance(again, PipelineModel) and pipeline.prepared_names(again) == pipeline.prepared_names(model)
    for rows in (tr, te):
        assert _features(again, rows) == _features(model, rows)
    score = [{r[0]: r[1][1] for r in m.transform(te).select("unique_id", vector_to_array("probability")).collect()} for m in (model, again)]
    assert score[0] == score[1] and len(score[0]) == te.count()


def test_pipeline_equals_the_operators(spark, loans):
    tr, te = loans
    want = train.fit_preparation(tr, "target", "unique_id")
    got = pipeline.preparation_pipeline(tr, "target", "unique_id").fit(tr)
    assert pipeline.prepared_names(got) == want.feature_names
    direct = {r["unique_id"]: list(r["x"]) for r in want.transform(te).select("unique_id", vector_to_array("features").alias("x")).collect()}
    assert _features(got, te) == direct
    # training rows carry folds: their target encodings are out of fold
    direct = {r["unique_id"]: list(r["x"]) for r in want.transform(tr, train=True).select("unique_id", vector_to_array("features").alias("x")).collect()}
    assert _features(got, tr) == direct


@pytest.mark.parametrize("stage", [
    pipeline.FrequencyEncoder(settings={"column": "state"}), pipeline.QuantileCapper(settings={"columns": ["loan_to_value"], "upper": 0.9}),
    pipeline.RobustScaler(settings={"columns": ["loan_to_value"], "cap": [0.01, 0.99]}), pipeline.OutlierImputer(settings={"column": "absent"})])
def test_single_stages_round_trip(spark, loans, tmp_path, stage):
    tr, te = loans
    stage.write().overwrite().save(str(tmp_path / "stage"))
    unfitted = type(stage).load(str(tmp_path / "stage"))
    model = unfitted.fit(tr)
    pipeline.save_pipeline(model, str(tmp_path / "model"))
    again = type(model).load(str(tmp_path / "model"))
    rows = [sorted(map(str, m.transform(te).collect())) for m in (model, again)]
    assert rows[0] == rows[1] and rows[0]


def test_unseen_and_missing_values_after_loading(spark, loans, tmp_path):
    tr, te = loans
    model = pipeline.preparation_pipeline(tr, "target", "unique_id").fit(tr)
    pipeline.save_pipeline(model, str(tmp_path / "m"))
    again = pipeline.load_pipeline(spark, str(tmp_path / "m"))
    odd = te.limit(5).withColumn("state", F.when(F.col("unique_id") % 2 == 0, "nowhere")).withColumn("loan_to_value", F.lit(None).cast("double"))
    got = _features(again, odd)
    names = pipeline.prepared_names(again)
    prior = tr.agg(F.avg(F.col("target").cast("double"))).first()[0]
    mode = tr.agg(F.mode("state", True)).first()[0]
    enc = next(s for s in model.stages if isinstance(s, pipeline.TargetEncoderModel)).fitted
    usual = enc.table.where(F.col("value") == mode).first()["enc"]
    for k, x in got.items():
        assert x[names.index("high_cardinality_categorical__state")] == pytest.approx(prior if k % 2 == 0 else usual)
        assert x[names.index("numeric__loan_to_value")] == 0.0
    assert len(got) == 5 and prep.LOW_CARDINALITY_LIMIT
