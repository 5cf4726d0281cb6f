"""The preparation as a Spark ML pipeline that can be saved and loaded.

Each operator of ``prep.py`` is an ``Estimator`` here, and what it learns a
``Model``.  Learned numbers and category lists are written as metadata,
learned tables (target means, frequencies) as parquet beside them.  The
assembler (M7) is a stage too, so a fitted preparation, with or without a
classifier behind it, is one ``PipelineModel``.

Rows with a ``fold`` column are training rows: target encodings are then
those learned without the row's own fold.
"""

from __future__ import annotations

import dataclasses
import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import prep

GROUP_PREFIXES = ("numeric__", "low_cardinality_categorical__", "high_cardinality_categorical__")


# ---------------------------------------------------------------- fitted stages
class _StateWriter(MLWriter):
    def __init__(self, stage: FittedStage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        state, tables = {}, {}
        for f in dataclasses.fields(self.stage.fitted):
            value = getattr(self.stage.fitted, f.name)
            (tables if isinstance(value, DataFrame) else state)[f.name] = value
        extra = {"state": json.dumps(state), "tables": sorted(tables)}
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession, extraMetadata=extra)
        for name, table in tables.items():
            table.write.parquet(f"{path}/{name}")


class _StateReader(MLReader):
    def __init__(self, kind: type[FittedStage]):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> FittedStage:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        state = json.loads(metadata["state"])
        tables = {name: self.sparkSession.read.parquet(f"{path}/{name}") for name in metadata["tables"]}
        stage = self.kind(self.kind.of(**state, **tables))
        stage._resetUid(metadata["uid"])
        return stage


class FittedStage(Model, MLWritable, MLReadable):
    """What an operator of ``prep.py`` learned (``fitted``), as a Spark ML model."""

    of: type

    def __init__(self, fitted=None):
        super().__init__()
        self.fitted = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.transform(dataset)

    def write(self) -> MLWriter:
        return _StateWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StateReader(cls)


class OutlierImputerModel(FittedStage):
    of = prep.LtvOutlierModel


class RobustScalerModel(FittedStage):
    of = prep.RobustScaleModel


class OneHotModel(FittedStage):
    of = prep.OneHotModel


class TargetEncoderModel(FittedStage):
    of = prep.TargetEncodeModel

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.transform(dataset, train="fold" in dataset.columns)


class FrequencyEncoderModel(FittedStage):
    of = prep.FrequencyModel


class QuantileCapperModel(FittedStage):
    of = prep.QuantileCapModel


# ---------------------------------------------------------------- stages to fit
class PreparationStage(Estimator, DefaultParamsWritable, DefaultParamsReadable):
    """An operator of ``prep.py`` with its settings, as a Spark ML estimator."""

    operator: type
    model: type[FittedStage]
    settings = Param(Params._dummy(), "settings", "keyword arguments of the operator")

    @keyword_only
    def __init__(self, *, settings: dict | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> FittedStage:
        given = self.getOrDefault(self.settings) if self.isDefined(self.settings) else {}
        return self.model(self.operator(**given).fit(dataset))


class OutlierImputer(PreparationStage):
    """M1."""

    operator, model = prep.LtvOutlierImputer, OutlierImputerModel


class RobustScaler(PreparationStage):
    """M4."""

    operator, model = prep.MedianImputeRobustScale, RobustScalerModel


class OneHot(PreparationStage):
    """M5."""

    operator, model = prep.ModeImputeOneHot, OneHotModel


class TargetEncoder(PreparationStage):
    """M6."""

    operator, model = prep.TargetEncoder, TargetEncoderModel


class FrequencyEncoder(PreparationStage):
    """K1."""

    operator, model = prep.FrequencyEncoder, FrequencyEncoderModel


class QuantileCapper(PreparationStage):
    """K2."""

    operator, model = prep.QuantileCapper, QuantileCapperModel


class FeatureAssembler(Estimator, DefaultParamsWritable, DefaultParamsReadable):
    """M7: the prepared columns, numeric, then low, then high cardinality, as one vector."""

    def _fit(self, dataset: DataFrame) -> VectorAssembler:
        names = [c for prefix in GROUP_PREFIXES for c in dataset.columns if c.startswith(prefix)]
        return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")


# ---------------------------------------------------------------- whole pipelines
def preparation_pipeline(train: DataFrame, target: str, id_col: str, classifier: Estimator | None = None, seed: int = 2) -> Pipeline:
    """M8: M1, M4, M5, M6 on the column groups (M2) of the training rows, M7, and a classifier if one is given."""
    groups = prep.feature_groups(train, exclude=[target, id_col, "is_test", "weight", "fold"])
    stages = [OutlierImputer(), RobustScaler(settings={"columns": groups["numeric"]}), OneHot(settings={"columns": groups["low"]}),
              *[TargetEncoder(settings={"column": c, "target": target, "id_col": id_col, "seed": seed}) for c in groups["high"]],
              FeatureAssembler()]
    return Pipeline(stages=[*stages, *([classifier] if classifier is not None else [])])


def prepared_names(model: PipelineModel) -> list[str]:
    """The names of the positions of the assembled vector."""
    return next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()


def prepared_features(model: PipelineModel, rows: DataFrame, id_col: str) -> DataFrame:
    """M8: (id, feature, value), a row for each position of the assembled vector."""
    names = F.array(*[F.lit(n) for n in prepared_names(model)])
    each = F.arrays_zip(names.alias("feature"), vector_to_array("features").alias("value"))
    return (model.transform(rows).select(id_col, F.explode(each).alias("x"))
            .select(id_col, F.col("x.feature").alias("feature"), F.col("x.value").alias("value")))


def save_pipeline(model: PipelineModel | Transformer, path: str) -> str:
    """Write a fitted pipeline (an older one at the path is replaced)."""
    model.write().overwrite().save(path)
    return path


def load_pipeline(spark: SparkSession, path: str) -> PipelineModel:
    """A fitted pipeline as it was saved; every stage class is found by its name in the metadata."""
    return PipelineModel.load(path)
