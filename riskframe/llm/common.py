"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.session import ensure_checkpoint_dir


#: fixed values: characters that separate words besides white space
SEPARATORS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”‘’„…–—·、。，"


def words_of(text: str) -> list[str]:
    """The lower-case words of a text: what lies between white space and separators."""
    text = text.lower()
    for mark in SEPARATORS:
        if mark in text:
            text = text.replace(mark, " ")
    return text.split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    The lineage ends at files that every executor sees, so a lost executor
    costs only the tasks it was running.
    """
    spark = df.sparkSession
    folder = ensure_checkpoint_dir(spark)
    path = f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (null for a null id)."""
    return F.crc32(id_col.cast("string")) % F.lit(parts)


def held_out(id_col: Column, parts: int, rest: int) -> Column:
    """True for ids of the held-out remainder; a null id is never held out."""
    return F.coalesce(fold(id_col, parts) == F.lit(rest), F.lit(False))


def salted_join(big: DataFrame, small: DataFrame, key: str, salts: int = 32) -> DataFrame:
    """Left join on one key of which a single value may hold a third of ``big``.

    Every row of ``small`` (one per key) is repeated ``salts`` times and the
    rows of ``big`` are dealt over the salts by a hash of all their columns.
    """
    names = [F.col(c) for c in big.columns]
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*names), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], "left").drop("_salt")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, rest: int,
                    limit: int) -> DataFrame:
    """(doc_id, text, y) of at most ``limit`` labelled documents outside the held-out fold.

    Labels are taken in the order of a hash of the id, so the choice does not
    depend on partitions.  An id with several labels counts with the largest;
    null ids and null labels take no part.  The chosen labels (``limit`` rows
    of 12 bytes) are the broadcast side, so no text is shuffled.
    """
    chosen = (labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y"))
              .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull()
                     & ~held_out(F.col("doc_id"), parts, rest))
              .groupBy("doc_id").agg(F.max("y").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    return (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
            .join(F.broadcast(chosen), "doc_id"))
