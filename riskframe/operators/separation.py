"""Cluster separation (P1-P11): which features differ most between clusters.

One ``unpivot`` to (label model, cluster, feature, value) and one
``groupBy(model, feature, cluster)`` give every per-cluster moment; a
second small aggregation over clusters yields eta squared, the ANOVA F
statistic and the spread of cluster means for all features at once.  Hot
clusters are harmless: the grouped aggregation combines map-side.
"""

from math import lgamma, log, pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.numeric import finite_or_null, numeric_columns, round_to
from .quantile import quantile_values


def attach_labels_checked(df: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """Rows joined with their label on the id; a missing label raises at run time."""
    joined = df.join(labels.select(id_col, label_col), id_col, "left")
    return joined.withColumn(label_col, F.when(F.col(label_col).isNull(),
                                               F.raise_error(F.lit(f"missing cluster label in {label_col}")))
                             .otherwise(F.col(label_col)))


def numeric_inputs(df: DataFrame, exclude: list[str]) -> list[str]:
    """number/bool columns minus the excluded ones."""
    return numeric_columns(df, exclude=exclude, include_bool=True)


def usable_features(df: DataFrame, cols: list[str]) -> list[str]:
    """Drop all-missing or constant columns (after +-inf -> null)."""
    if not cols:
        return []
    xs = [finite_or_null(F.col(f"`{c}`").cast("double")) for c in cols]
    row = df.agg(*[F.min(x).alias(f"lo_{i}") for i, x in enumerate(xs)],
                 *[F.max(x).alias(f"hi_{i}") for i, x in enumerate(xs)]).first()
    # more than one distinct value iff min < max
    return [c for i, c in enumerate(cols) if row[f"lo_{i}"] is not None and row[f"lo_{i}"] < row[f"hi_{i}"]]


def median_impute(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """Null (and +-inf) -> the column median learned on ``df``."""
    xs = [finite_or_null(F.col(f"`{c}`").cast("double")) for c in cols]
    med = quantile_values(df, dict(zip(cols, xs)), [0.5], approx)
    return df.withColumns({c: F.coalesce(x, F.lit(med[c] and med[c][0]).cast("double")) for c, x in zip(cols, xs)})


def _cluster_moments(long: DataFrame, keys: list[str]) -> DataFrame:
    return long.groupBy(*keys, "feature", "cluster").agg(
        F.count(F.lit(1)).alias("n_c"), F.avg("value").alias("mean_c"),
        F.var_samp("value").alias("var_c"))


def analyze_many(df: DataFrame, label_cols: list[str], exclude: list[str] | None = None) -> DataFrame:
    """P9 (P2-P8 per label column): separation table with a ``model`` column."""
    exclude = list(exclude or []) + label_cols
    cols = usable_features(df, numeric_inputs(df, exclude))
    if not cols:
        raise ValueError("no usable numeric feature")
    imputed = median_impute(df, cols)
    long = (imputed.select(*[F.col(c).alias(f"label__{c}") for c in label_cols], *cols)
            .unpivot([f"label__{c}" for c in label_cols], cols, "feature", "value")
            .unpivot(["feature", "value"], [f"label__{c}" for c in label_cols], "model", "cluster")
            .withColumn("model", F.regexp_replace("model", "^label__", "")))
    per = _cluster_moments(long, ["model"])
    glob = long.groupBy("model", "feature").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    # one row per (model, feature): bounded by the schema width
    j = per.join(F.broadcast(glob), ["model", "feature"])
    dev = F.col("mean_c") - F.col("mean")
    stats = j.groupBy("model", "feature").agg(
        F.first("n").alias("n"), F.count(F.lit(1)).alias("k"), F.first("std").alias("std"),
        F.sum(F.col("n_c") * dev * dev).alias("ssb"),
        F.sum(F.coalesce(F.col("var_c"), F.lit(0.0)) * (F.col("n_c") - 1)).alias("ssw"),
        F.min(F.struct("mean_c", "cluster")).alias("lo"), F.max(F.struct("mean_c", F.negative("cluster").alias("nc"))).alias("hi"),
        F.max(F.abs(dev)).alias("max_abs_dev"))
    sst = F.col("ssb") + F.col("ssw")
    return stats.select(
        "model", "feature",
        F.when(sst > 0, F.col("ssb") / sst).alias("eta_squared"),
        F.col("lo.mean_c").alias("cluster_mean_min"), F.col("hi.mean_c").alias("cluster_mean_max"),
        (F.col("hi.mean_c") - F.col("lo.mean_c")).alias("cluster_mean_range"),
        F.col("lo.cluster").alias("cluster_with_min_mean"),
        F.negative(F.col("hi.nc")).alias("cluster_with_max_mean"),
        F.when(F.col("std") > 0, F.col("max_abs_dev") / F.col("std")).alias("max_abs_standardized_cluster_mean"),
        F.when((F.col("k") > 1) & (F.col("n") > F.col("k")) & (F.col("ssw") > 0),
               (F.col("ssb") / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n") - F.col("k"))))
        .alias("anova_f_score"),
        (F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"),
    )


def analyze_separation(df: DataFrame, label_col: str, exclude: list[str] | None = None) -> DataFrame:
    """Separation table for one label column, ordered eta^2, F, spread desc."""
    out = analyze_many(df, [label_col], exclude).drop("model")
    return out.orderBy(F.desc_nulls_last("eta_squared"), F.desc_nulls_last("anova_f_score"),
                       F.desc_nulls_last("max_abs_standardized_cluster_mean"), "feature")


def _stirling_rest(z: np.ndarray) -> np.ndarray:
    """log gamma(z) less Stirling's (z - 1/2) log z - z + log(2 pi) / 2: a series from 10 on, where the difference would cancel."""
    small = np.minimum(z, 10.0)
    exact = np.array([lgamma(v) for v in small]) - (small - 0.5) * np.log(small) + small - 0.5 * log(2 * pi)
    big = 1.0 / np.maximum(z, 10.0)
    series = big * (1 / 12 - big ** 2 * (1 / 360 - big ** 2 * (1 / 1260 - big ** 2 * (1 / 1680 - big ** 2 / 1188))))
    return np.where(z < 10.0, exact, series)


def _f_tail(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """P(F > f) for f of 1 and more.

    With a = d2/2, b = d1/2, x = a/(a + b f) and y = 1 - x, substituting
    t = x exp(-s/a) in the incomplete beta integral gives
    x^a y^b / (a y B(a, b)) times the integral over s > 0 of
    exp(-s) (1 + (x/y) (1 - exp(-s/a)))^(b-1), which falls in s.  It is summed
    by Gauss-Legendre on panels of doubling width; the factor before it is
    written so that no two large terms cancel, whatever the degrees of freedom.
    """
    a, b = d2 / 2.0, d1 / 2.0
    y = b * f / (a + b * f)
    front = (b * np.log1p(a * (f - 1) / (a + b * f)) - a * np.log1p(b * (f - 1) / (a + b)) + 0.5 * (np.log(b) - np.log1p(b / a)) - 0.5 * log(2 * pi)
             - _stirling_rest(a) - _stirling_rest(b) + _stirling_rest(a + b)) - np.log(a * y)
    node, weight = np.polynomial.legendre.leggauss(32)
    total, lo, hi = np.zeros_like(f), 0.0, 0.125
    while lo < 1e13:
        s = lo + (hi - lo) * (node + 1) / 2
        grown = (a / (b * f))[:, None] * -np.expm1(-s[None, :] / a[:, None])
        part = np.exp(front[:, None] - s[None, :] + (b - 1)[:, None] * np.log1p(grown)) @ weight * (hi - lo) / 2
        total += part
        if (part <= 1e-17 * total).all() and lo > 1:
            break
        lo, hi = hi, 2 * hi
    return np.minimum(total, 1.0)


def f_survival(f, d1, d2):
    """P(F > f) for the F(d1, d2) distribution, vectorised (numpy), for degrees of freedom of any size."""
    f, d1, d2 = np.broadcast_arrays(*(np.atleast_1d(np.asarray(v, dtype="float64")) for v in (f, d1, d2)))
    out = np.where(f <= 0, 1.0, np.where(np.isinf(f), 0.0, np.nan))
    above, below = (f >= 1) & np.isfinite(f), (f > 0) & (f < 1)
    out[above] = _f_tail(f[above], d1[above], d2[above])
    # F(d1, d2) lies below f where its inverse, F(d2, d1), lies above 1/f
    out[below] = 1.0 - _f_tail(1 / f[below], d2[below], d1[below])
    return out


def with_anova_p_value(sep: DataFrame) -> DataFrame:
    """P5: p-value of the F statistic, a vectorised pandas UDF over the result rows."""
    @F.pandas_udf(T.DoubleType())
    def p_value(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        out = np.full(len(f), np.nan)
        ok = f.notna() & (d1 > 0) & (d2 > 0)
        if ok.any():
            out[ok.to_numpy()] = f_survival(f[ok].to_numpy(), d1[ok].to_numpy(), d2[ok].to_numpy())
        return pd.Series(out)

    return sep.withColumn("anova_p_value", p_value("anova_f_score", F.col("df_between").cast("double"),
                                                   F.col("df_within").cast("double")))


def top_separating_features(sep: DataFrame, model: str, n: int = 15) -> DataFrame:
    """P10: the model's top-n features by eta^2, F, spread."""
    if "model" in sep.columns:
        sep = sep.where(F.col("model") == model)
    # order on 6-digit values so exact ties (e.g. proportional columns) fall to the name
    w = Window.partitionBy("model").orderBy(
        round_to("eta_squared", 6).desc_nulls_last(), round_to("anova_f_score", 6).desc_nulls_last(),
        round_to("max_abs_standardized_cluster_mean", 6).desc_nulls_last(), "feature")
    return sep.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def profile_features(top: DataFrame, domain: list[str]) -> DataFrame:
    """The domain list first, then the data-driven top features; first occurrence kept."""
    spark = top.sparkSession
    dom = spark.createDataFrame([(f, i) for i, f in enumerate(domain)], "feature string, position int")
    data = top.select("feature", (F.lit(len(domain)) + F.col("rank")).cast("int").alias("position"))
    both = dom.unionByName(data)
    return both.groupBy("feature").agg(F.min("position").alias("position"))
