"""Model preparation (M1-M8) and clustering preparation (K1-K5).

Each transformer is an Estimator/Model pair: ``fit`` learns small state on
the training rows with one aggregation (quantiles, modes, category lists,
per-category statistics) and ``transform`` is a projection or a join with
that state.  Quantile state is exact by default (``operators/quantile.py``,
the reference's linear interpolation); ``approx=True`` takes one sketch at
its word.  Category tables
for high-cardinality columns are joined without a broadcast hint, so Spark
chooses broadcast or shuffle from their measured size.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import rules
from ..functions.numeric import finite_or_null, is_numeric, numeric_columns  # noqa: F401
from ..session import ensure_checkpoint_dir
from .profile import distinct_counts
from .quantile import exact_quantiles, quantile_values
from .split import assign_folds

LOW_CARDINALITY_LIMIT = 10


def _name(c: str) -> str:
    return f"`{c}`"


# ---------------------------------------------------------------- M1
@dataclass
class LtvOutlierModel:
    column: str
    lower: float | None
    upper: float | None
    median: float | None

    def transform(self, df: DataFrame) -> DataFrame:
        if self.column not in df.columns or self.median is None:
            return df
        x = F.col(_name(self.column)).cast("double")
        out = F.when((x < F.lit(self.lower)) | (x > F.lit(self.upper)), F.lit(self.median)).otherwise(x)
        return df.withColumn(self.column, out)


@dataclass
class LtvOutlierImputer:
    """M1: values strictly outside the [lower, upper] train quantiles -> train median."""

    column: str = "loan_to_value"
    lower_quantile: float = 0.01
    upper_quantile: float = 0.99
    approx: bool = False

    def fit(self, df: DataFrame) -> LtvOutlierModel:
        if self.column not in df.columns:
            return LtvOutlierModel(self.column, None, None, None)
        x = F.col(_name(self.column)).cast("double")
        found = quantile_values(df, {"x": x}, [self.lower_quantile, self.upper_quantile, 0.5], self.approx)["x"]
        if found is None:
            return LtvOutlierModel(self.column, None, None, None)
        lo, hi, med = found
        return LtvOutlierModel(self.column, lo, hi, med)


# ---------------------------------------------------------------- M2 / M3 / K4
def feature_groups(df: DataFrame, exclude: list[str] | None = None,
                   threshold: int = LOW_CARDINALITY_LIMIT,
                   forced_high: list[str] | None = None) -> dict[str, list[str]]:
    """M2/K4: numeric (number/bool), low- and high-cardinality categorical columns."""
    exclude = set(exclude or [])
    forced = set(rules.FORCED_HIGH_CARDINALITY if forced_high is None else forced_high)
    numeric = [f.name for f in df.schema.fields if f.name not in exclude and is_numeric(f.dataType)]
    cats = [f.name for f in df.schema.fields if f.name not in exclude and f.name not in numeric]
    if not cats:
        return {"numeric": numeric, "low": [], "high": []}
    nd = {r["column"]: r["unique_count"] for r in distinct_counts(df, cats).collect()}
    low = [c for c in cats if c not in forced and nd.get(c, 0) < threshold]
    high = [c for c in cats if c not in low]
    return {"numeric": numeric, "low": low, "high": high}


def feature_group_table(df: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """M2 as a table: (column, feature_group)."""
    g = feature_groups(df, exclude)
    rows = [(c, k) for k in ("numeric", "low", "high") for c in g[k]]
    names = {"numeric": "numeric", "low": "low_cardinality_categorical",
             "high": "high_cardinality_categorical"}
    return df.sparkSession.createDataFrame([(c, names[k]) for c, k in rows], "column string, feature_group string")


def split_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """M3: (features without the target, target column); error if absent."""
    if target not in df.columns:
        raise ValueError(f"{target} not found")
    return df.drop(target), df.select(target)


# ---------------------------------------------------------------- M4 (+K2)
@dataclass
class RobustScaleModel:
    stats: dict[str, tuple[float, float, float]]   # column -> (median, q1, q3)
    caps: dict[str, tuple[float, float]] = field(default_factory=dict)
    prefix: str = "numeric__"

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, (med, q1, q3) in self.stats.items():
            x = F.coalesce(finite_or_null(F.col(_name(c)).cast("double")), F.lit(med))
            if c in self.caps:
                lo, hi = self.caps[c]
                x = F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
            iqr = q3 - q1
            out[f"{self.prefix}{c}"] = (x - F.lit(med)) / F.lit(iqr if iqr != 0 else 1.0)
        return df.withColumns(out)


@dataclass
class MedianImputeRobustScale:
    """M4: null -> train median, then (x - median) / IQR (IQR 0 -> divide by 1).

    With ``cap`` (K5 numeric branch) values are clipped to the train
    [1 %, 99 %] quantiles after imputation and before scaling, and the
    scaling statistics are those of the clipped train column.
    """

    columns: list[str]
    cap: tuple[float, float] | None = None
    approx: bool = False
    prefix: str = "numeric__"

    def fit(self, df: DataFrame) -> RobustScaleModel:
        xs = {c: finite_or_null(F.col(_name(c)).cast("double")) for c in self.columns}
        quartiles, known = [0.5, 0.25, 0.75], {}
        if self.cap and xs and not self.approx:
            table = exact_quantiles(df, xs, [*quartiles, *self.cap]).collect()
            found, known = {r["column"]: r["q"] for r in table}, {r["column"]: r["n"] for r in table}
        else:
            found = quantile_values(df, xs, [*quartiles, *(self.cap or ())], self.approx)
        if not self.cap:
            return RobustScaleModel({c: tuple(q or (0.0, 0.0, 0.0)) for c, q in found.items()}, {}, self.prefix)
        caps = {c: tuple(q[3:]) for c, q in found.items() if q}
        # impute, clip, then learn the scaling statistics on the clipped column
        clipped = {}
        for c, x in xs.items():
            x = F.coalesce(x, F.lit((found[c] or [0.0])[0]))
            clipped[c] = F.least(F.greatest(x, F.lit(caps[c][0])), F.lit(caps[c][1])) if c in caps else x
        # where nothing is imputed and both neighbours of a quartile lie within the caps, clipping leaves the quartiles as they are
        rows = df.count() if known else None
        kept = {c: found[c][:3] for c, n in known.items() if n and n == rows and all(
            floor(p * (n - 1)) >= ceil(self.cap[0] * (n - 1)) and ceil(p * (n - 1)) <= floor(self.cap[1] * (n - 1)) for p in quartiles)}
        again = quantile_values(df, {c: x for c, x in clipped.items() if c not in kept}, quartiles, self.approx)
        scaled = {c: kept[c] if c in kept else again[c] for c in self.columns}
        # the centre of the scaled value is the clipped median
        return RobustScaleModel({c: tuple(q or (0.0, 0.0, 0.0)) for c, q in scaled.items()}, caps, self.prefix)


# ---------------------------------------------------------------- M5
@dataclass
class OneHotModel:
    modes: dict[str, str | None]
    categories: dict[str, list[str]]
    prefix: str = "low_cardinality_categorical__"

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, cats in self.categories.items():
            v = F.coalesce(F.col(_name(c)).cast("string"), F.lit(self.modes[c]))
            for cat in cats:
                out[f"{self.prefix}{c}_{cat}"] = F.when(v == F.lit(cat), F.lit(1.0)).otherwise(F.lit(0.0))
        return df.withColumns(out)


@dataclass
class ModeImputeOneHot:
    """M5: null -> most frequent train value (smallest on ties); one 0/1 column per
    train category (sorted); an unseen value gives all zeros."""

    columns: list[str]
    prefix: str = "low_cardinality_categorical__"

    def fit(self, df: DataFrame) -> OneHotModel:
        if not self.columns:
            return OneHotModel({}, {}, self.prefix)
        row = df.agg(*[F.mode(F.col(_name(c)).cast("string"), True).alias(f"m_{i}") for i, c in enumerate(self.columns)],
                     *[F.array_sort(F.collect_set(F.col(_name(c)).cast("string"))).alias(f"s_{i}")
                       for i, c in enumerate(self.columns)]).first()
        modes = {c: row[f"m_{i}"] for i, c in enumerate(self.columns)}
        cats = {c: list(row[f"s_{i}"]) for i, c in enumerate(self.columns)}
        return OneHotModel(modes, cats, self.prefix)


# ---------------------------------------------------------------- M6
@dataclass
class TargetEncodeModel:
    column: str
    target: str
    mode: str | None
    table: DataFrame            # (value, enc) from all train rows
    prior: float
    oof: DataFrame | None       # (value, fold, enc) out-of-fold encodings for train rows
    out_col: str

    def transform(self, df: DataFrame, train: bool = False) -> DataFrame:
        v = F.coalesce(F.col(_name(self.column)).cast("string"), F.lit(self.mode))
        d = df.withColumn("_te_value", v)
        if train and self.oof is not None and "fold" in df.columns:
            j = d.join(self.oof.withColumnRenamed("value", "_te_value"), ["_te_value", "fold"], "left")
        else:
            j = d.join(self.table.withColumnRenamed("value", "_te_value"), "_te_value", "left")
        return j.withColumn(self.out_col, F.coalesce(F.col("enc"), F.lit(self.prior))).drop("_te_value", "enc")


def _encode(n, s, ss, mean_all, var_all):
    """lambda * category mean + (1 - lambda) * prior, lambda = V n / (V n + v_c)."""
    mean_c = s / n
    var_c = ss / n - mean_c * mean_c
    lam = F.try_divide(var_all * n, var_all * n + F.greatest(var_c, F.lit(0.0)))
    return F.coalesce(lam, F.lit(0.0)) * mean_c + (F.lit(1.0) - F.coalesce(lam, F.lit(0.0))) * mean_all


@dataclass
class TargetEncoder:
    """M6: smoothed target mean per category; train rows encoded out of fold."""

    column: str
    target: str
    id_col: str
    n_folds: int = 5
    seed: int = 2
    prefix: str = "high_cardinality_categorical__"

    def fit(self, df: DataFrame) -> TargetEncodeModel:
        mode = df.agg(F.mode(F.col(_name(self.column)).cast("string"), True)).first()[0]
        y = F.col(self.target).cast("double")
        v = F.coalesce(F.col(_name(self.column)).cast("string"), F.lit(mode)).alias("value")
        # counts by (value, fold), once; all else follows from this table
        ensure_checkpoint_dir(df.sparkSession)
        folded = assign_folds(df, self.target, self.id_col, self.n_folds, self.seed).select(v, "fold", y.alias("y"))
        per = folded.groupBy("value", "fold").agg(
            F.count(F.lit(1)).alias("fn"), F.sum("y").alias("fs"), F.sum(F.col("y") * F.col("y")).alias("fss")).checkpoint()
        by_fold = per.groupBy("fold").agg(F.sum("fn").alias("n"), F.sum("fs").alias("s"), F.sum("fss").alias("ss")).collect()
        n_all, s_all, ss_all = (sum(r[c] for r in by_fold) for c in ("n", "s", "ss"))
        mean_all = s_all / n_all
        var_all = ss_all / n_all - mean_all * mean_all
        cat = per.groupBy("value").agg(F.sum("fn").alias("n"), F.sum("fs").alias("s"), F.sum("fss").alias("ss"))
        table = cat.select("value", _encode(F.col("n"), F.col("s"), F.col("ss"), F.lit(mean_all), F.lit(var_all)).alias("enc"))
        others = []  # fold, mean and variance of the other folds
        for r in by_fold:
            n_o = n_all - r["n"]
            mean_o = (s_all - r["s"]) / n_o
            others.append((r["fold"], mean_o, (ss_all - r["ss"]) / n_o - mean_o * mean_o))
        every = F.explode(F.array(*[F.struct(F.lit(f).alias("fold"), F.lit(m).alias("mean_o"), F.lit(o).alias("var_o")) for f, m, o in others]))
        rest = (cat.withColumn("_o", every).select("value", "n", "s", "ss", "_o.*").join(per, ["value", "fold"], "left")
                .select("value", "fold", "mean_o", "var_o", F.nullif(F.col("n") - F.coalesce("fn", F.lit(0)), F.lit(0)).alias("n"),
                        (F.col("s") - F.coalesce("fs", F.lit(0.0))).alias("s"), (F.col("ss") - F.coalesce("fss", F.lit(0.0))).alias("ss")))
        # a category of this fold only: the mean of the other folds
        oof = rest.select("value", "fold", F.coalesce(_encode(F.col("n"), F.col("s"), F.col("ss"), F.col("mean_o"), F.col("var_o")),
                                                      F.col("mean_o")).alias("enc"))
        return TargetEncodeModel(self.column, self.target, mode, table, mean_all, oof,
                                 f"{self.prefix}{self.column}")


# ---------------------------------------------------------------- K1, K2
@dataclass
class FrequencyModel:
    column: str
    table: DataFrame   # (value, freq)
    missing_label: str
    out_col: str

    def transform(self, df: DataFrame) -> DataFrame:
        v = F.coalesce(F.col(_name(self.column)).cast("string"), F.lit(self.missing_label))
        j = df.withColumn("_fq_value", v).join(self.table.withColumnRenamed("value", "_fq_value"), "_fq_value", "left")
        return j.withColumn(self.out_col, F.coalesce(F.col("freq"), F.lit(0.0))).drop("_fq_value", "freq")


@dataclass
class FrequencyEncoder:
    """K1: null -> 'Unknown'; value -> train relative frequency; unseen -> 0."""

    column: str
    missing_label: str = rules.MISSING_FILL
    out_col: str | None = None

    def fit(self, df: DataFrame) -> FrequencyModel:
        v = F.coalesce(F.col(_name(self.column)).cast("string"), F.lit(self.missing_label)).alias("value")
        g = df.select(v).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        table = g.select("value", (F.col("n") / F.lit(df.count())).alias("freq"))
        return FrequencyModel(self.column, table, self.missing_label, self.out_col or f"{self.column}_frequency")


@dataclass
class QuantileCapModel:
    bounds: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, (lo, hi) in self.bounds.items():
            x = F.col(_name(c)).cast("double")
            out[c] = F.when(x.isNull(), F.lit(None)).otherwise(F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))
        return df.withColumns(out)


@dataclass
class QuantileCapper:
    """K2: clip each column to its train [lower, upper] quantiles (nulls ignored when learning)."""

    columns: list[str]
    lower: float = 0.01
    upper: float = 0.99
    approx: bool = False

    def fit(self, df: DataFrame) -> QuantileCapModel:
        found = quantile_values(df, {c: finite_or_null(F.col(_name(c)).cast("double")) for c in self.columns},
                                [self.lower, self.upper], self.approx)
        return QuantileCapModel({c: tuple(q) for c, q in found.items() if q})


def exclude_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """K3: drop the target (or any listed column) if present."""
    return df.drop(*[c for c in columns if c in df.columns])

