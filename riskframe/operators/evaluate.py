"""Classifier evaluation on a ``scored(model, row_id, y, score)`` table.

V1-V8, TH1-TH4, N7, N10-N12, N16.  All areas and curves derive from one
cumulative table per (model, distinct score).  Its running sums are built
without a whole-model window: scores are cut into approximate-quantile
buckets, bucket totals give the offset above each bucket (a table of
models x buckets rows), and only the rows of one bucket share a window.
Threshold sweeps bucket each score by the number of grid points below it,
so one aggregation serves every threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCORE_BUCKETS = 256


def default_grid(stop: int = 18) -> list[float]:
    """Thresholds i/20 for i = 1..stop (0.05 .. 0.90 by default)."""
    return [i / 20 for i in range(1, stop + 1)]


def predict_at_threshold(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """V1: prediction = 1 when score >= threshold."""
    return scored.withColumn("prediction",
                             F.when(F.col("score") >= F.lit(threshold), F.lit(1)).otherwise(F.lit(0)))


def _rate(num: Column, den: Column) -> Column:
    """num / den, 0 when the denominator is 0 (zero_division = 0)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def metrics_from_counts(tp="tp", tn="tn", fp="fp", fn="fn") -> dict[str, Column]:
    """V3: threshold metrics from the four confusion counts."""
    tp, tn, fp, fn = (F.col(c) for c in (tp, tn, fp, fn))
    n = tp + tn + fp + fn
    recall = _rate(tp, tp + fn)
    specificity = _rate(tn, tn + fp)
    return {
        "accuracy": _rate(tp + tn, n),
        "balanced_accuracy": (recall + specificity) / F.lit(2.0),
        "precision": _rate(tp, tp + fp),
        "recall": recall,
        "f1_score": _rate(F.lit(2) * tp, F.lit(2) * tp + fp + fn),
        "true_positive": tp, "true_negative": tn, "false_positive": fp, "false_negative": fn,
        "predicted_positive_rate": _rate(tp + fp, n),
    }


def confusion_counts(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """V2: tn, fp, fn, tp per model in one pass."""
    pred = F.col("score") >= F.lit(threshold)
    y = F.col("y") == 1
    return scored.groupBy("model").agg(
        F.count_if(~pred & ~y).alias("tn"), F.count_if(pred & ~y).alias("fp"),
        F.count_if(~pred & y).alias("fn"), F.count_if(pred & y).alias("tp"))


def _below(bounds: Column, coarse: Column, score: Column) -> Column:
    """How many of the ascending ``bounds`` are less than ``score``: ``coarse`` (every 16th) is compared, then the 16 where it falls."""
    coarse = F.size(F.filter(coarse, lambda v: v < score))
    return F.when(bounds.isNull(), F.size(bounds)).otherwise(16 * coarse + F.size(F.filter(F.slice(bounds, 16 * coarse + 1, 16), lambda v: v < score)))


def cumulative_table(scored: DataFrame, n_buckets: int = SCORE_BUCKETS) -> DataFrame:
    """(model, score, pos, neg, tp, fp, P, N): counts at each distinct score and
    the cumulative positives/negatives with score >= it."""
    g = scored.groupBy("model", "score").agg(
        F.sum(F.col("y").cast("bigint")).alias("pos"),
        (F.count(F.lit(1)) - F.sum(F.col("y").cast("bigint"))).alias("neg"))
    ps = [i / n_buckets for i in range(1, n_buckets)]
    # models x buckets boundaries: size bounded by the bucket count per model
    bounds = g.groupBy("model").agg(F.percentile_approx("score", ps, 10_000).alias("_b"))
    bounds = bounds.withColumn("_c", F.filter("_b", lambda v, i: i % 16 == 15))
    g = g.join(F.broadcast(bounds), "model").withColumn("bucket", _below(F.col("_b"), F.col("_c"), F.col("score"))).drop("_b", "_c")
    tot = g.groupBy("model", "bucket").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    above = Window.partitionBy("model").orderBy(F.desc("bucket")).rowsBetween(
        Window.unboundedPreceding, -1)
    whole = Window.partitionBy("model")
    tot = tot.select("model", "bucket",
                     F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("pos_above"),
                     F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("neg_above"),
                     F.sum("bp").over(whole).alias("P"), F.sum("bn").over(whole).alias("N"))
    within = Window.partitionBy("model", "bucket").orderBy(F.desc("score")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (g.join(F.broadcast(tot), ["model", "bucket"])
             .select("model", "score", "pos", "neg",
                     (F.col("pos_above") + F.sum("pos").over(within)).alias("tp"),
                     (F.col("neg_above") + F.sum("neg").over(within)).alias("fp"),
                     "P", "N"))


def areas(scored: DataFrame) -> DataFrame:
    """V4 + V5: ROC AUC (ties count half) and average precision per model."""
    c = cumulative_table(scored)
    return c.groupBy("model").agg(
        F.try_divide(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / F.lit(2.0))),
                     F.first("P").cast("double") * F.first("N")).alias("roc_auc"),
        F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))),
                     F.first("P").cast("double")).alias("pr_auc"))


def roc_curve_points(scored: DataFrame) -> DataFrame:
    """(fpr, tpr, threshold) at each distinct score."""
    c = cumulative_table(scored)
    return c.select("model", F.col("score").alias("threshold"),
                    F.try_divide(F.col("fp").cast("double"), F.col("N")).alias("fpr"),
                    F.try_divide(F.col("tp").cast("double"), F.col("P")).alias("tpr"))


def pr_curve_points(scored: DataFrame) -> DataFrame:
    """(recall, precision, threshold) at each distinct score."""
    c = cumulative_table(scored)
    return c.select("model", F.col("score").alias("threshold"),
                    F.try_divide(F.col("tp").cast("double"), F.col("P")).alias("recall"),
                    F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")).alias("precision"))


def metrics_table(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """V8 (+V6): one row per model at the threshold, ordered by pr_auc desc."""
    cc = confusion_counts(scored, threshold)
    m = metrics_from_counts()
    out = cc.join(areas(scored), "model").select(
        "model", F.lit(float(threshold)).alias("threshold"),
        *[m[k].alias(k) for k in ("accuracy", "balanced_accuracy", "precision", "recall", "f1_score")],
        "roc_auc", "pr_auc",
        *[m[k].alias(k) for k in ("true_positive", "true_negative", "false_positive",
                                  "false_negative", "predicted_positive_rate")],
        F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("confusion_matrix"))
    return out.orderBy(F.desc("pr_auc"), "model")


def classification_report(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """V7: per class precision/recall/F1/support, accuracy, macro and weighted rows."""
    cc = confusion_counts(scored, threshold)
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    n = tp + tn + fp + fn
    cls = []
    for label, t_p, f_p, f_n in (("0", tn, fn, fp), ("1", tp, fp, fn)):
        p, r = _rate(t_p, t_p + f_p), _rate(t_p, t_p + f_n)
        cls.append(F.struct(F.lit(label).alias("label"), p.alias("precision"), r.alias("recall"),
                            _rate(F.lit(2) * t_p, F.lit(2) * t_p + f_p + f_n).alias("f1_score"),
                            (t_p + f_n).alias("support")))
    per = cc.select("model", n.alias("n"), (tp + tn).alias("correct"),
                    F.explode(F.array(*cls)).alias("c")).select("model", "n", "correct", "c.*")
    base = per.select("model", "label", "precision", "recall", "f1_score", "support")
    avg = per.groupBy("model").agg(
        F.first("n").alias("n"), F.first("correct").alias("correct"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
        F.sum(F.col("precision") * F.col("support")).alias("wp"),
        F.sum(F.col("recall") * F.col("support")).alias("wr"),
        F.sum(F.col("f1_score") * F.col("support")).alias("wf"))
    acc = _rate(F.col("correct"), F.col("n"))
    extra = avg.select("model", F.explode(F.array(
        F.struct(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), acc.alias("f1_score"), F.col("n").alias("support")),
        F.struct(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"),
                 F.col("mr").alias("recall"), F.col("mf").alias("f1_score"), F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), (F.col("wp") / F.col("n")).alias("precision"),
                 (F.col("wr") / F.col("n")).alias("recall"), (F.col("wf") / F.col("n")).alias("f1_score"),
                 F.col("n").alias("support")))).alias("c")).select("model", "c.*")
    return base.unionByName(extra)


def threshold_sweep(scored: DataFrame, grid: list[float] | None = None,
                    models: list[str] | None = None) -> DataFrame:
    """TH1/TH2: metrics at every grid threshold for every model, in one aggregation."""
    grid = sorted(grid or default_grid())
    if models is not None:
        scored = scored.where(F.col("model").isin(models))
    g = F.array(*[F.lit(float(t)) for t in grid])
    # bucket k = number of grid points <= score: score >= grid[j] iff bucket > j
    b = scored.select("model", "y", F.size(F.filter(g, lambda t: t <= F.col("score"))).alias("bucket"))
    counts = b.groupBy("model", "bucket").agg(
        F.sum(F.col("y").cast("bigint")).alias("pos"),
        (F.count(F.lit(1)) - F.sum(F.col("y").cast("bigint"))).alias("neg"))
    totals = counts.groupBy("model").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    points = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(float(t)).alias("threshold"))
                       for j, t in enumerate(grid)])
    full = totals.select("model", "P", "N", F.explode(points).alias("g")).select("model", "P", "N", "g.*")
    # a bucket-k row counts towards every grid point j < k; counts has at most
    # models x (grid + 1) rows, so this fan-out is bounded by the grid size
    above = (counts.where(F.col("bucket") > 0)
             .select("model", "pos", "neg", F.explode(F.sequence(F.lit(0), F.col("bucket") - 1)).alias("j"))
             .groupBy("model", "j").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp")))
    full = full.join(above, ["model", "j"], "left")
    full = full.select("model", "threshold",
                       F.coalesce("tp", F.lit(0)).cast("bigint").alias("tp"),
                       F.coalesce("fp", F.lit(0)).cast("bigint").alias("fp"),
                       (F.col("P") - F.coalesce("tp", F.lit(0))).cast("bigint").alias("fn"),
                       (F.col("N") - F.coalesce("fp", F.lit(0))).cast("bigint").alias("tn"))
    m = metrics_from_counts()
    return full.select("threshold", *[m[k].alias(k) for k in (
        "accuracy", "balanced_accuracy", "precision", "recall", "f1_score", "true_positive",
        "true_negative", "false_positive", "false_negative", "predicted_positive_rate")], "model")


STRATEGIES = {
    "max_f1": ["f1_score", "precision", "recall"],
    "max_balanced_accuracy": ["balanced_accuracy", "f1_score", "precision"],
    "max_precision": ["precision", "recall", "f1_score"],
    "max_recall": ["recall", "precision", "f1_score"],
}


def _constrained(sweep: DataFrame, min_recall=None, min_precision=None, max_ppr=None) -> DataFrame:
    if min_recall is not None:
        sweep = sweep.where(F.col("recall") >= F.lit(min_recall))
    if min_precision is not None:
        sweep = sweep.where(F.col("precision") >= F.lit(min_precision))
    if max_ppr is not None:
        sweep = sweep.where(F.col("predicted_positive_rate") <= F.lit(max_ppr))
    return sweep


def select_best_thresholds(sweep: DataFrame, strategy: str = "max_f1", min_recall=None,
                           min_precision=None, max_ppr=None, models: list[str] | None = None,
                           check: bool = True) -> DataFrame:
    """TH3/TH4: best row per model by the strategy's ordering, under the limits.

    With ``check`` an unknown model or a model with no admissible row raises,
    as the reference does (one small aggregate is collected for it).
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; choose one of {sorted(STRATEGIES)}")
    if models is not None:
        sweep = sweep.where(F.col("model").isin(models))
    ok = _constrained(sweep, min_recall, min_precision, max_ppr)
    order = [F.desc(c) for c in STRATEGIES[strategy]] + [F.asc("threshold")]
    w = Window.partitionBy("model").orderBy(*order)
    best = ok.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
    if check:
        have = {r["model"] for r in best.select("model").collect()}
        want = set(models) if models is not None else {r["model"] for r in sweep.select("model").distinct().collect()}
        missing = sorted(want - have)
        if missing:
            raise ValueError(f"no threshold satisfies the limits for models {missing}")
    return best.orderBy(F.desc("f1_score"), "model")


def threshold_sensitivity(scored: DataFrame, model: str, grid: list[float] | None = None) -> DataFrame:
    """Counts, precision, recall and predicted-positive rate on a grid for one model."""
    grid = grid or [i / 20 for i in range(5, 16)]
    s = threshold_sweep(scored, grid, [model])
    return s.select("model", "threshold", "true_positive", "true_negative", "false_positive",
                    "false_negative", "precision", "recall", "predicted_positive_rate")


def confusion_matrix_table(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """2x2 counts per model, actual class by predicted class."""
    p = predict_at_threshold(scored, threshold)
    return (p.groupBy("model", F.col("y").alias("actual")).pivot("prediction", [0, 1]).count()
            .select("model", "actual", F.coalesce(F.col("0"), F.lit(0)).alias("predicted_0"),
                    F.coalesce(F.col("1"), F.lit(0)).alias("predicted_1")))


RANK_METRICS = ["roc_auc", "pr_auc", "f1_score", "precision", "recall", "balanced_accuracy"]


def models_ranked_by_metric(metrics: DataFrame, metric_names: list[str] | None = None) -> DataFrame:
    """For each metric, the models ordered by it (rank 1 = best)."""
    names = metric_names or RANK_METRICS
    long = metrics.select("model", *[F.col(m).cast("double") for m in names]).unpivot(
        ["model"], names, "metric", "value")
    w = Window.partitionBy("metric").orderBy(F.desc("value"), "model")
    return long.withColumn("rank", F.row_number().over(w))
