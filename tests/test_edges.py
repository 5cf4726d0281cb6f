"""Edge cases and laws on hand-made tables (nulls, zeros, band edges, ties)."""

import math

from pyspark.sql import functions as F

from riskframe.functions import rules
from riskframe.functions.numeric import safe_divide
from riskframe.operators import evaluate, features, profile, separation, split
from riskframe.operators.cluster_eval import silhouette


def test_safe_divide_guards(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (5.0, 2.0), (3.0, 1000.0), (3.0, 1001.0)], "n double, d double")
    got = [r[0] for r in df.select(safe_divide("n", "d", 1000)).collect()]
    assert got == [None, None, None, None, 3.0 / 1001.0]
    got = [r[0] for r in df.select(safe_divide("n", "d")).collect()]
    assert got == [None, None, 2.5, 0.003, 3.0 / 1001.0]


def test_fico_bands_at_edges(spark):
    vals = [None, 299, 300, 579, 580, 669, 670, 739, 740, 799, 800, 900]
    df = spark.createDataFrame([(v,) for v in vals], "fico_score bigint")
    out = df.withColumns(features.fico_features({"fico_score"})).collect()
    assert [r["fico_rating"] for r in out] == [
        "Unknown", "Bureau Excluded", "Poor", "Poor", "Fair", "Fair", "Good", "Good", "Very Good",
        "Very Good", "Exceptional", "Exceptional"]
    assert [r["fico_rating_ordinal"] for r in out] == [None, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert [r["is_bureau_excluded"] for r in out][:3] == [0, 1, 0]


def test_right_closed_bands(spark):
    df = spark.createDataFrame([(v,) for v in [None, 0, 5, 6, 11, 12, 35, 59, 60]], "a bigint")
    got = [r[0] for r in df.select(rules.band_right_closed("a", rules.CREDIT_HISTORY_BANDS)).collect()]
    assert got == [None, "Very Young", "Very Young", "Young", "Young", "Established", "Established",
                   "Mature", "Seasoned"]


def test_auc_brute_force_and_monotone_invariance(spark):
    rows = [(i, i % 3 == 0, float((i * 37) % 11)) for i in range(60)]
    df = spark.createDataFrame([("m", i, int(y), s) for i, y, s in rows], "model string, row_id int, y int, score double")
    auc = evaluate.areas(df).first()["roc_auc"]
    pos = [s for _, y, s in rows if y]
    neg = [s for _, y, s in rows if not y]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(auc - brute) < 1e-12
    auc2 = evaluate.areas(df.withColumn("score", F.exp("score"))).first()["roc_auc"]
    assert abs(auc - auc2) < 1e-12


def test_average_precision_step_sum(spark):
    ys = [1, 0, 1, 1, 0, 0, 1, 0]
    ss = [0.9, 0.8, 0.8, 0.6, 0.5, 0.4, 0.3, 0.1]
    df = spark.createDataFrame([("m", i, y, s) for i, (y, s) in enumerate(zip(ys, ss))],
                               "model string, row_id int, y int, score double")
    ap = evaluate.areas(df).first()["pr_auc"]
    # by hand over distinct thresholds: 0.9, 0.8, 0.6, 0.5, 0.4, 0.3, 0.1
    P = 4
    pts, tp, fp, prev_r, total = sorted(set(ss), reverse=True), 0, 0, 0.0, 0.0
    for t in pts:
        tp += sum(1 for y, s in zip(ys, ss) if s == t and y)
        fp += sum(1 for y, s in zip(ys, ss) if s == t and not y)
        r = tp / P
        total += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    assert abs(ap - total) < 1e-12


def test_split_is_exact_disjoint_and_complete(spark):
    df = spark.range(0, 1003).select(F.col("id").alias("uid"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    s = split.stratified_split(df, "y", "uid", 0.2, 2)
    assert s.count() == 1003
    per = {r["y"]: (r["n"], r["t"]) for r in s.groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect()}
    for n, t in per.values():
        assert t == math.floor(n * 0.2 + 0.5)


def test_correlation_skips_constants_and_nulls(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0, None), (2.0, 4.1, 5.0, 1.0), (3.0, 5.9, 5.0, 2.0),
                                (4.0, 8.2, 5.0, 3.0)], "a double, b double, c double, d double")
    m = {(r["feature_1"], r["feature_2"]): r["correlation"] for r in profile.correlation_matrix(df).collect()}
    assert m[("a", "c")] is None
    assert abs(m[("a", "d")] - 1.0) < 1e-9          # pairwise complete: rows 2..4 only
    assert m[("a", "b")] > 0.99


def test_f_survival_closed_form():
    # F(2, d2) tail = (1 + 2 f / d2) ** (-d2 / 2)
    got = separation.f_survival([3.0], [2.0], [10.0])[0]
    assert abs(got - 1.6 ** -5) < 1e-9


def test_silhouette_matches_brute_force(spark):
    pts = [(0, [0.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.0], 0), (3, [5.0, 5.0], 1), (4, [6.0, 5.0], 1),
           (5, [5.0, 7.0], 1), (6, [9.0, 0.0], 2)]
    df = spark.createDataFrame(pts, "row_id int, features array<double>, cluster int")
    got = silhouette(df).first()[0]

    def dist(a, b):
        return math.dist(a, b)
    s = []
    for i, x, c in pts:
        own = [dist(x, y) for j, y, d in pts if d == c and j != i]
        if not own:
            s.append(0.0)
            continue
        a = sum(own) / len(own)
        b = min(sum(dist(x, y) for _, y, d in pts if d == o) / sum(1 for _, _, d in pts if d == o)
                for o in {d for _, _, d in pts} if o != c)
        s.append((b - a) / max(a, b))
    assert abs(got - sum(s) / len(s)) < 1e-12


def test_duplicated_rows_keeps_surplus_copies(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, None), (2, None), (2, None)], "k int, v string")
    assert profile.duplicated_rows(df).count() == 3
    by_key = profile.duplicated_rows(df, ["k"]).collect()
    assert len(by_key) == 4
