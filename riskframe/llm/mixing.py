"""Mixing sources to target weights by Pareto order sampling.

A document of a source with target/size ratio ``m`` gets ``floor(m)`` certain
copies; one more copy goes to a sample drawn with inclusion probability
``m - floor(m)``.  Every document has a random odds value ``u / (1 - u)``
(``u`` from a keyed hash of its id and text); divided by its inclusion odds
``p / (1 - p)`` this is its Pareto rank.  Within a source, the documents of
lowest rank are selected until the words still missing are filled.  The cut
rank is found from exact word counts of rank intervals, refined twice, so a
source that holds a third of all rows is never ordered in one task.

Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import cut, salted_join

WORD = r"[^\x20\x09-\x0D]+"
#: intervals per refinement of the cut rank
STEPS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: int, *cols: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the given columns only."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2 ** 53))


def pareto_rank(u: Column, p: Column) -> Column:
    """Random odds over inclusion odds, mapped from (0, inf) into (0, 1) by q / (1 + q)."""
    q = (u / (F.lit(1.0) - u)) * ((F.lit(1.0) - p) / p)
    return F.when(p > 0, q / (F.lit(1.0) + q))


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def source_targets(sized: DataFrame, weights: Sequence[float], max_repeat: float) -> DataFrame:
    """One row per source: key, source_size, target.

    ``sized`` has (key, size).  Sources in code point order (null last) weigh
    ``weights`` in turn and share the sum of all sizes; no target is above
    ``max_repeat`` times its source's size and the excess is shared again.
    With sources ordered by cap / weight, the common level per weight is the
    largest of (total - caps before) / (weights from here on).  The windows
    without partition hold one row per source.
    """
    by_source = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = by_source.withColumn("n", F.row_number().over(Window.orderBy("key")))
    rows = rows.withColumn("w", F.element_at(cycle, F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    order = Window.orderBy(F.col("cap") / F.col("w"), "key")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    rows = rows.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                           / F.sum("w").over(after))
    rows = rows.withColumn("level", F.max("level").over(whole))
    return rows.select("key", "source_size", F.least("cap", F.col("w") * F.col("level")).alias("target"))


def _crossing(hist: DataFrame, by: list[str], bucket: str) -> DataFrame:
    """For each group, the first bucket whose running sum passes ``rest``; ``rest`` less what lies below it."""
    run = Window.partitionBy(*by).orderBy(bucket)
    total = F.sum("words").over(run)
    return (hist.withColumn("upto", total)
            .where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
            .groupBy(*by).agg(F.min(F.struct(bucket, (F.col("rest") - F.col("upto") + F.col("words")).alias("rest"))).alias("c"))
            .select(*by, F.col(f"c.{bucket}").alias(bucket), F.col("c.rest").alias("rest")))


def mixing_plan(slim: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeat: float = 3.0) -> DataFrame:
    """One row per source: key, source_size, target, certain (copies), p, cut (rank up to which one more copy is taken).

    ``slim`` has (key, size, u) and should be a written table: it is read
    three times.
    """
    targets = source_targets(slim.select("key", "size"), weights, max_repeat)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = cut(targets.withColumn("certain", F.floor(ratio + F.lit(1e-12)).cast("long"))
               .withColumn("p", F.greatest(ratio - F.col("certain"), F.lit(0.0)))
               .withColumn("rest", F.col("target") - F.col("certain") * F.col("source_size")))
    ranked = (salted_join(slim.where(F.col("size") > 0), plan.select("key", "p", "rest"), "key")
              .where(F.col("p") > 0).withColumn("r", pareto_rank(F.col("u"), F.col("p")))
              .withColumn("b1", F.floor(F.col("r") * STEPS).cast("int"))
              .withColumn("b2", F.pmod(F.floor(F.col("r") * STEPS * STEPS), F.lit(STEPS)).cast("int")))
    first = _crossing(ranked.groupBy("key", "b1").agg(F.sum("size").cast("double").alias("words"), F.first("rest").alias("rest")),
                      ["key"], "b1")
    second = (salted_join(ranked.drop("rest"), first.withColumnRenamed("b1", "c1"), "key")
              .where(F.col("b1") == F.col("c1"))
              .groupBy("key", "b1", "b2").agg(F.sum("size").cast("double").alias("words"), F.first("rest").alias("rest")))
    second = cut(_crossing(second, ["key", "b1"], "b2"))
    inner = (salted_join(ranked.drop("rest"), second.select("key", F.col("b1").alias("c1"), F.col("b2").alias("c2"), "rest"), "key")
             .where((F.col("b1") == F.col("c1")) & (F.col("b2") == F.col("c2"))))
    # rows of one interval of 1 / STEPS**2 of the ranks; equal ranks are taken or left together
    run = Window.partitionBy("key").orderBy("r").rangeBetween(Window.unboundedPreceding, 0)
    upto = F.sum("size").over(run)
    last = (inner.withColumn("upto", upto)
            .withColumn("miss", F.abs(F.col("upto") - F.col("rest")))
            .groupBy("key").agg(F.min(F.struct("miss", "r")).alias("best"), F.first("rest").alias("rest"),
                                F.min("b1").alias("b1"), F.min("b2").alias("b2")))
    floor = (F.col("b1") * F.lit(float(STEPS)) + F.col("b2")) / F.lit(float(STEPS) ** 2)
    # leave the whole interval out when that comes nearer to the target than any of its ranks
    cuts = last.select("key", F.when(F.col("best.miss") <= F.col("rest"), F.col("best.r")).otherwise(floor - F.lit(1e-15)).alias("cut"))
    return cut(plan.join(cuts, "key", "left")
               .withColumn("cut", F.when(F.col("p") > 0, F.coalesce("cut", F.lit(1.0))).otherwise(F.lit(-1.0)))
               .select("key", "source_size", "target", "certain", "p", "cut"))


def decide(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds source_size, target and copies to rows that have (key, u)."""
    joined = salted_join(rows, plan, "key")
    rank = pareto_rank(F.col("u"), F.col("p"))
    more = F.when((F.col("p") > 0) & (rank <= F.col("cut")), F.lit(1)).otherwise(F.lit(0))
    return joined.withColumn("copies", (F.col("certain") + more).cast("long")).drop("certain", "p", "cut")


def _keyed(docs: DataFrame, seed: int, keep: Column) -> DataFrame:
    return docs.select(keep.alias("doc"), _source_key(F.col("source")).alias("key"), word_count(F.col("text")).alias("size"),
                       uniform(seed, F.col("doc_id"), F.col("text")).alias("u"))


def mix_report(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeat: float = 3.0,
               seed: int = 20240229) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every document.

    ``docs`` needs doc_id, text, source; other columns are ignored.  Null and
    empty texts have size 0; a null source is a source of its own, after all
    others.  Rows that agree in id and text are decided alike.  An empty table
    gives an empty result.  The same rows give the same result in any
    partitioning.
    """
    slim = cut(_keyed(docs, seed, F.col("doc_id")))
    plan = mixing_plan(slim.select("key", "size", "u"), weights, max_repeat)
    out = decide(slim, plan)
    return out.select(F.col("doc").alias("doc_id"), "size", "source_size", "target", "copies",
                      (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeat: float = 3.0,
                  seed: int = 20240229) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as its copies, with the columns of ``docs``."""
    slim = cut(_keyed(docs, seed, F.lit(None).cast("int")).select("key", "size", "u"))
    plan = mixing_plan(slim, weights, max_repeat)
    rows = decide(_keyed(docs, seed, F.struct(*[F.col(f"`{c}`") for c in docs.columns])), plan)
    return (rows.where(F.col("copies") > 0)
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select("doc.*"))
