"""Stratified split (T1), class weights (T6) and fold assignment.

Randomness is a hash of (row id, seed) that both Spark and SQL can compute,
so splits are reproducible and checkable.  The split is exact (the same
rows as "first round(frac * n_class) rows per class by hash") without a
window over a whole class: hashes are cut into equal-width buckets, bucket
counts (a small table) locate the bucket where each class's quota ends, and
only the rows of that one bucket are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ensure_checkpoint_dir

#: hash buckets of a class; a bucket is the share of rows that one task ranks
BUCKETS = 1 << 16


def hash_key(id_col: str, seed: int) -> Column:
    """md5 hex of "<id>|<seed>"; order by it (then by id) to shuffle reproducibly."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))


def _unit(key: Column) -> Column:
    """First 13 hex digits of the hash as a number in [0, 1) (monotone in the hex order)."""
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))


def stratified_split(df: DataFrame, label: str, id_col: str, test_fraction: float = 0.2,
                     seed: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``is_test``; per class exactly floor(frac * n + 0.5) test rows, chosen by hash.

    Ids are distinct.  Bucket counts place the quota; only rows of the one
    bucket per class in which it ends are ranked, and every row is compared
    with its class's last test key (one broadcast row per class, found once,
    whatever the number of passes over the result).
    """
    ensure_checkpoint_dir(df.sparkSession)
    keyed = df.withColumn("_key", hash_key(id_col, seed))
    keyed = keyed.withColumn("_bucket", F.floor(_unit(F.col("_key")) * buckets).cast("int"))
    counts = keyed.groupBy(F.col(label).alias("_class"), "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # (classes x buckets) rows: the quota bookkeeping never touches raw rows
    w_cls = Window.partitionBy("_class")
    w_run = w_cls.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    quota = counts.select(
        "_class", "_bucket", "_n",
        (F.floor(F.sum("_n").over(w_cls) * F.lit(float(test_fraction)) + F.lit(0.5))
         - F.coalesce(F.sum("_n").over(w_run), F.lit(0))).alias("_left"))
    whole = quota.groupBy("_class").agg(F.max(F.when(F.col("_left") >= F.col("_n"), F.col("_bucket"))).alias("_whole"))
    ends = quota.where((F.col("_left") > 0) & (F.col("_left") < F.col("_n"))).select(
        "_class", F.col("_bucket").alias("_end"), "_left")
    own = F.col(label).eqNullSafe(F.col("_class"))
    last = (keyed.select(label, "_key", "_bucket", F.col(id_col).alias("_id"))
            .join(F.broadcast(ends), own & (F.col("_bucket") == F.col("_end")))
            .withColumn("_r", F.row_number().over(Window.partitionBy("_class").orderBy("_key", "_id")))
            .where(F.col("_r") <= F.col("_left"))
            .groupBy(F.col("_class").alias("_c")).agg(F.max(F.struct("_key", "_id")).alias("_cut")))
    cuts = whole.join(last, F.col("_class").eqNullSafe(F.col("_c")), "left").drop("_c").checkpoint()
    is_test = (F.coalesce(F.col("_bucket") <= F.col("_whole"), F.lit(False))
               | F.coalesce(F.struct("_key", F.col(id_col).alias("_id")) <= F.col("_cut"), F.lit(False)))
    return (keyed.join(F.broadcast(cuts), own).withColumn("is_test", is_test)
            .drop("_key", "_bucket", "_class", "_whole", "_cut"))


def assign_folds(df: DataFrame, label: str, id_col: str, n_folds: int = 5, seed: int = 2,
                 buckets: int = BUCKETS) -> DataFrame:
    """Stratified fold number 0..n_folds-1: position in the class's hash order, modulo n_folds."""
    key = hash_key(id_col, seed + 1)
    w = Window.partitionBy(label, F.col("_b")).orderBy("_k", id_col)
    # bucket first so that no window spans a whole class, then offset by bucket counts
    k = df.withColumn("_k", key).withColumn("_b", F.floor(_unit(F.col("_k")) * buckets).cast("int"))
    counts = k.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    off = counts.select(label, "_b", F.coalesce(F.sum("_n").over(
        Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    pos = k.join(off, [label, "_b"]).withColumn("_pos", F.col("_off") + F.row_number().over(w) - 1)
    return pos.withColumn("fold", (F.col("_pos") % n_folds).cast("int")).drop("_k", "_b", "_off", "_pos")


def balanced_weights(df: DataFrame, label: str, weight_col: str = "weight") -> DataFrame:
    """w = n / (n_classes * n_class) for every row."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    w = Window.partitionBy()  # over the handful of classes only
    per = per.select(label, (F.sum("_nc").over(w) / (F.count(F.lit(1)).over(w) * F.col("_nc"))).alias(weight_col))
    return df.join(F.broadcast(per), label)  # one row per class
