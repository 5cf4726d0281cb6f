"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver tables (through the fixture views) and runs
over whole tables.  Double outputs pass through ``round_doubles`` so the
result does not depend on summation order (the SQL oracle does the same).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import round_doubles
from ..operators import clean, features, profile
from ..session import staged
from ..sources import fixtures

TARGET = "target"
BOX_COLUMNS = ["disbursed_amount", "loan_to_value", "fico_score", "current_balance_amount"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


def labelled_features(spark, sf):
    return features.build_features(fixtures.loans_labelled(spark, sf))


def unlabelled_features(spark, sf):
    return features.build_features(fixtures.loans_unlabelled(spark, sf))


# ------------------------------------------------------------------ S, C, F
@register("loan_book")
def q_loan_book(spark, sf):
    """The raw loan view derived from the driver tables."""
    return fixtures.loan_book(spark, sf)


@register("rename_columns")
def q_rename(spark, sf):
    """C1."""
    return clean.rename_columns(fixtures.loans_labelled(spark, sf))


@register("serial_day_to_date")
def q_serial(spark, sf):
    """C1 + C2: serial day numbers become dates."""
    return clean.serial_day_to_date(clean.rename_columns(fixtures.loans_labelled(spark, sf)))


@register("standardize_missing")
def q_missing(spark, sf):
    """C3."""
    return clean.standardize_missing(fixtures.loans_labelled(spark, sf))


@register("drop_duplicate_rows")
def q_dedup(spark, sf):
    """C4."""
    return clean.drop_duplicate_rows(fixtures.loans_labelled(spark, sf))


@register("drop_noninformative_columns")
def q_drop(spark, sf):
    """C5."""
    return clean.drop_noninformative_columns(fixtures.loans_labelled(spark, sf))


@register("preprocess")
def q_preprocess(spark, sf):
    """C6."""
    return clean.preprocess(fixtures.loans_labelled(spark, sf))


@register("build_features")
def q_features(spark, sf):
    """F20 (flagship chain) on the labelled loans."""
    return labelled_features(spark, sf)


@register("build_features_unlabelled")
def q_features_unlabelled(spark, sf):
    """the same build on the unlabelled loans (own reference date)."""
    return unlabelled_features(spark, sf)


@register("fico_features")
def q_fico(spark, sf):
    """F4-F7 on the raw loans."""
    book = fixtures.loan_book(spark, sf)
    return book.select("unique_id", "fico_score").withColumns(features.fico_features({"fico_score"}))


@register("balance_features")
def q_balance(spark, sf):
    """F1, F8-F10 on the raw loans."""
    book = fixtures.loan_book(spark, sf).select(
        "unique_id", "current_balance_amount", "instalment_amount", "disbursed_amount")
    return book.withColumns(features.balance_features(set(book.columns)))


@register("account_features")
def q_accounts(spark, sf):
    """F11, F12, F14, F16 on the raw loans (with the delinquency column)."""
    book = fixtures.loan_book(spark, sf).select(
        "unique_id", "number_of_accounts", "number_of_active_accounts", "number_of_overdue_accounts",
        "number_of_accounts_opened_last_6_months", "number_of_delinquencies_last_6_months",
        "average_account_age", "number_of_inquiries")
    cols = set(book.columns)
    exprs = {**features.account_activity(cols), **features.overdue_ratios(cols),
             **features.credit_history(cols), **features.inquiry_features(cols)}
    return book.withColumns(exprs)


@register("ltv_features")
def q_ltv(spark, sf):
    """F17 on the raw loans."""
    book = fixtures.loan_book(spark, sf).select("unique_id", "loan_to_value")
    return book.withColumns(features.ltv_features({"loan_to_value"}))


# ------------------------------------------------------------------ E, N
@register("compare_columns")
def q_compare(spark, sf):
    """Raw labelled loans against the built feature table."""
    return profile.compare_columns(fixtures.loans_labelled(spark, sf), labelled_features(spark, sf))


@register("compare_columns_unlabelled")
def q_compare_unlabelled(spark, sf):
    """Raw unlabelled loans against their built feature table."""
    return profile.compare_columns(fixtures.loans_unlabelled(spark, sf), unlabelled_features(spark, sf))


@register("dataframe_overview")
def q_overview(spark, sf):
    """E2."""
    return profile.dataframe_overview(labelled_features(spark, sf))


@register("duplicate_summary")
def q_dup_summary(spark, sf):
    """E3 on the raw loans, id = unique_id."""
    return profile.duplicate_summary(fixtures.loans_labelled(spark, sf), "unique_id")


@register("missing_summary")
def q_missing_summary(spark, sf):
    """E4."""
    return profile.missing_summary(labelled_features(spark, sf))


@register("constant_columns")
def q_constant(spark, sf):
    """E5 on the raw loans."""
    return profile.constant_columns(fixtures.loans_labelled(spark, sf))


@register("target_summary")
def q_target_summary(spark, sf):
    """E6."""
    return profile.target_summary(labelled_features(spark, sf), TARGET)


@register("numeric_summary")
def q_numeric_summary(spark, sf):
    """E7."""
    return profile.numeric_summary(labelled_features(spark, sf))


@register("negative_numeric_summary")
def q_negative(spark, sf):
    """E8."""
    return profile.negative_numeric_summary(labelled_features(spark, sf))


@register("categorical_summary")
def q_categorical(spark, sf):
    """E9, top 10."""
    return profile.categorical_summary(labelled_features(spark, sf), 10)


@register("rate_by_category")
def q_rate_by_category(spark, sf):
    """E10 (flagship answer): default rate by each low-cardinality category."""
    return profile.rate_by_category(labelled_features(spark, sf), TARGET, 10)


@register("rate_by_category_documents")
def q_rate_docs(spark, sf):
    """E10 on the second domain: toxic rate by language and source."""
    return profile.rate_by_category(fixtures.doc_labels(spark, sf), "toxic", 25)


@register("rate_by_quantile_bin")
def q_rate_qbin(spark, sf):
    """E11, 5 bins."""
    return profile.rate_by_quantile_bin(labelled_features(spark, sf), TARGET, 5)


@register("rate_by_uniform_bin")
def q_rate_ubin(spark, sf):
    """E12, 5 bins."""
    return profile.rate_by_uniform_bin(labelled_features(spark, sf), TARGET, 5)


@register("outlier_summary")
def q_outliers(spark, sf):
    """E13, 5 % / 95 %."""
    return profile.outlier_summary(labelled_features(spark, sf), 0.05, 0.95)


@register("correlated_pairs")
def q_corr_pairs(spark, sf):
    """E14, |r| >= 0.8."""
    return profile.correlated_pairs(labelled_features(spark, sf), TARGET, 0.8)


@register("target_correlation")
def q_target_corr(spark, sf):
    """E15."""
    return profile.target_correlation(labelled_features(spark, sf), TARGET)


@register("correlated_pairs_with_target")
def q_corr_target(spark, sf):
    """E16."""
    return profile.correlated_pairs_with_target(labelled_features(spark, sf), TARGET, 0.8)


@register("missing_rate_top_n")
def q_missing_top(spark, sf):
    """E17 on the raw loans (top 20)."""
    return profile.missing_rate_top_n(fixtures.loans_labelled(spark, sf), 20)


@register("target_distribution")
def q_target_dist(spark, sf):
    """E18."""
    return profile.target_distribution(labelled_features(spark, sf), TARGET)


@register("boxplot_stats")
def q_boxplot(spark, sf):
    """E19 for four amount/score columns."""
    return profile.boxplot_stats(labelled_features(spark, sf), BOX_COLUMNS)


@register("correlation_matrix")
def q_corr_matrix(spark, sf):
    """E20."""
    return profile.correlation_matrix(labelled_features(spark, sf))


@register("duplicated_rows")
def q_dup_rows(spark, sf):
    """Full-row repeats in the raw loans."""
    return profile.duplicated_rows(fixtures.loans_labelled(spark, sf))


@register("duplicated_ids")
def q_dup_ids(spark, sf):
    """Rows repeating an earlier unique_id."""
    return profile.duplicated_rows(fixtures.loans_labelled(spark, sf), ["unique_id"])


@register("missing_rate_table")
def q_missing_table(spark, sf):
    """First 10 missing rates of the feature table."""
    return profile.missing_rate_table(unlabelled_features(spark, sf), 10)


@register("quantile_spread")
def q_spread(spark, sf):
    """Top 20 range/IQR ratios of the clustering inputs."""
    return profile.quantile_spread(unlabelled_features(spark, sf), 20)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry(): features -> default rate by category."""
    return QUERIES["rate_by_category"](spark, sf_dir)


__all__ = ["QUERIES", "flagship", "F"]


# ------------------------------------------------------------------ V, TH, L, N (scored fixture)
from ..operators import evaluate, select  # noqa: E402

FINAL_MIN_RECALL = 0.5


def _scored(spark, sf):
    return fixtures.scored(spark, sf)


@register("predict_at_threshold")
def q_predict(spark, sf):
    """V1 at 0.5."""
    return evaluate.predict_at_threshold(_scored(spark, sf), 0.5)


@register("confusion_counts")
def q_confusion(spark, sf):
    """V2 at 0.5."""
    return evaluate.confusion_counts(_scored(spark, sf), 0.5)


@register("threshold_metrics")
def q_threshold_metrics(spark, sf):
    """V3 at 0.5."""
    cc = evaluate.confusion_counts(_scored(spark, sf), 0.5)
    m = evaluate.metrics_from_counts()
    return cc.select("model", *[v.alias(k) for k, v in m.items()])


@register("roc_pr_auc")
def q_areas(spark, sf):
    """V4 + V5."""
    return evaluate.areas(_scored(spark, sf))


@register("metrics_table")
def q_metrics_table(spark, sf):
    """V6 + V8: one row per model with the nested confusion matrix."""
    return evaluate.metrics_table(_scored(spark, sf), 0.5)


@register("classification_report")
def q_report(spark, sf):
    """V7."""
    return evaluate.classification_report(_scored(spark, sf), 0.5)


@register("threshold_sweep")
def q_sweep(spark, sf):
    """TH1 + TH2 on the default grid 0.05 .. 0.90."""
    return evaluate.threshold_sweep(_scored(spark, sf))


@register("best_thresholds_max_f1")
def q_best_f1(spark, sf):
    """TH3 + TH4, strategy max_f1."""
    return evaluate.select_best_thresholds(evaluate.threshold_sweep(_scored(spark, sf)), "max_f1")


@register("best_thresholds_max_precision_recall70")
def q_best_prec(spark, sf):
    """TH3 + TH4, max_precision with recall >= 0.70."""
    return evaluate.select_best_thresholds(evaluate.threshold_sweep(_scored(spark, sf)),
                                           "max_precision", min_recall=0.70)


def _selection(spark, sf):
    s = _scored(spark, sf)
    best = evaluate.select_best_thresholds(evaluate.threshold_sweep(s), "max_f1")
    return select.selection_table(evaluate.metrics_table(s, 0.5), best)


@register("model_selection_table")
def q_selection(spark, sf):
    """L1 + L2 + L3 + L5."""
    return _selection(spark, sf)


@register("final_model")
def q_final(spark, sf):
    """L4 + L6 with selected recall >= 0.5."""
    return select.select_final_model(_selection(spark, sf), min_recall=FINAL_MIN_RECALL)


@register("threshold_sensitivity")
def q_sensitivity(spark, sf):
    """N7 for the linear scorer, grid 0.25 .. 0.75."""
    return evaluate.threshold_sensitivity(_scored(spark, sf), "linear")


@register("roc_curve_points")
def q_roc_points(spark, sf):
    """N10."""
    return evaluate.roc_curve_points(_scored(spark, sf))


@register("pr_curve_points")
def q_pr_points(spark, sf):
    """N11."""
    return evaluate.pr_curve_points(_scored(spark, sf))


@register("confusion_matrix_table")
def q_cm_table(spark, sf):
    """N12."""
    return evaluate.confusion_matrix_table(_scored(spark, sf), 0.5)


@register("models_ranked_by_metric")
def q_ranked(spark, sf):
    """N16."""
    return evaluate.models_ranked_by_metric(evaluate.metrics_table(_scored(spark, sf), 0.5))


# ------------------------------------------------------------------ X (embeddings labellings)
from ..operators import cluster_eval  # noqa: E402

CLUSTERINGS = [("label_k10", None, 10), ("labelmod_k2", 2, 2), ("labelmod_k3", 3, 3),
               ("labelmod_k5", 5, 5)]
COVERING_SAMPLE = 100


def cluster_metrics(spark, sf):
    parts = [cluster_eval.evaluate_clustering(fixtures.assigned(spark, sf, mod), name, k)
             for name, mod, k in CLUSTERINGS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("assigned_cluster_count")
def q_x1(spark, sf):
    """X1 on cluster = label."""
    return cluster_eval.assigned_cluster_count(fixtures.assigned(spark, sf))


@register("cluster_covering_sample")
def q_x2(spark, sf):
    """100-row covering sample of label % 3."""
    return cluster_eval.cluster_covering_sample(fixtures.assigned(spark, sf, 3), COVERING_SAMPLE, 42)


@register("silhouette")
def q_x3(spark, sf):
    """X3 on label % 3."""
    return cluster_eval.silhouette(fixtures.assigned(spark, sf, 3))


@register("cluster_size_stats")
def q_x4(spark, sf):
    """X4 on cluster = label."""
    return cluster_eval.cluster_size_stats(fixtures.assigned(spark, sf))


@register("davies_bouldin_calinski")
def q_x67(spark, sf):
    """X6 + X7 (+ inertia) on label % 3."""
    return cluster_eval.davies_bouldin_calinski(fixtures.assigned(spark, sf, 3))


@register("clustering_metrics")
def q_xmetrics(spark, sf):
    """X3-X7 for four labellings of the embeddings."""
    return cluster_metrics(spark, sf)


@register("rank_clusterings")
def q_x8(spark, sf):
    """X8."""
    return cluster_eval.rank_clusterings(cluster_metrics(spark, sf))


@register("valid_clusterings")
def q_x9(spark, sf):
    """X9."""
    return cluster_eval.filter_valid(cluster_metrics(spark, sf))


@register("silhouette_curve")
def q_x10(spark, sf):
    """X10."""
    return cluster_eval.metric_curve(cluster_metrics(spark, sf), "silhouette_score")


@register("inertia_elbow_curve")
def q_x11(spark, sf):
    """X11."""
    return cluster_eval.metric_curve(cluster_metrics(spark, sf), "inertia")


@register("promising_models")
def q_n14(spark, sf):
    """First three ranked clusterings."""
    return cluster_eval.rank_clusterings(cluster_metrics(spark, sf)).where(F.col("rank") <= 3)


# ------------------------------------------------------------------ P, W, N9, N13 (segmented loans)
from ..operators import segments, separation  # noqa: E402

SEG_EXCLUDE = ["unique_id", "target", "cluster", "cluster_ltv"]
SEG_FEATURES = ["fico_score", "loan_to_value", "disbursed_amount", "current_balance_amount",
                "number_of_accounts", "number_of_overdue_accounts", "number_of_inquiries", "age",
                "average_account_age"]
SEG_CATEGORICAL = ["employment_type", "state"]
DOMAIN_FEATURES = ["fico_score", "loan_to_value", "number_of_overdue_accounts"]
MANUAL_LABELS = {0: "Thin or excluded bureau file", 1: "Subprime borrowers"}


def _seg(spark, sf):
    return staged(fixtures.segmented(spark, sf))


def _profile(spark, sf):
    return segments.profile_long(_seg(spark, sf), SEG_FEATURES)


@register("attach_labels")
def q_p1(spark, sf):
    """Distinct loans joined with their cluster label on unique_id."""
    seg = _seg(spark, sf)
    book = fixtures.loan_book(spark, sf).dropDuplicates()
    return separation.attach_labels_checked(book, seg.select("unique_id", "cluster"), "unique_id", "cluster")


@register("separation_analysis")
def q_p8(spark, sf):
    """P2-P8 for the FICO-band labelling."""
    return separation.analyze_separation(_seg(spark, sf), "cluster", SEG_EXCLUDE).drop("df_between", "df_within")


@register("separation_many")
def q_p9(spark, sf):
    """Both labellings, model in the key."""
    return separation.analyze_many(_seg(spark, sf), ["cluster", "cluster_ltv"], SEG_EXCLUDE) \
        .drop("df_between", "df_within")


@register("separation_p_values")
def q_p5(spark, sf):
    """P5: ANOVA F with its p-value (F-distribution tail, no SQL counterpart)."""
    sep = separation.analyze_many(_seg(spark, sf), ["cluster"], SEG_EXCLUDE)
    return separation.with_anova_p_value(sep).select("model", "feature", "anova_f_score", "anova_p_value")


@register("top_separating_features")
def q_p10(spark, sf):
    """P10: top 15 for the FICO-band labelling."""
    sep = separation.analyze_many(_seg(spark, sf), ["cluster", "cluster_ltv"], SEG_EXCLUDE)
    return separation.top_separating_features(sep, "cluster", 15).drop("df_between", "df_within")


@register("profile_features")
def q_p11(spark, sf):
    """Domain features then the top 5 data-driven ones, first occurrence kept."""
    sep = separation.analyze_many(_seg(spark, sf), ["cluster"], SEG_EXCLUDE)
    return separation.profile_features(separation.top_separating_features(sep, "cluster", 5), DOMAIN_FEATURES)


@register("cluster_size_summary")
def q_w2(spark, sf):
    """W2."""
    return segments.cluster_size_summary(_seg(spark, sf))


@register("numeric_profile")
def q_w3(spark, sf):
    """Mean and median per cluster and feature."""
    return segments.numeric_profile(_seg(spark, sf), SEG_FEATURES)


@register("numeric_mean_profile")
def q_w4(spark, sf):
    """W4 (an unknown feature name is ignored)."""
    return segments.numeric_mean_profile(_seg(spark, sf), SEG_FEATURES + ["no_such_feature"])


@register("relative_profile")
def q_w5(spark, sf):
    """W5."""
    return segments.relative_profile(_seg(spark, sf), SEG_FEATURES)


@register("profile_long")
def q_w6(spark, sf):
    """W6."""
    return _profile(spark, sf)


@register("categorical_profile")
def q_w7(spark, sf):
    """W7, top 5 values per cluster."""
    return segments.categorical_profile(_seg(spark, sf), SEG_CATEGORICAL, top_n=5)


@register("top_distinguishing")
def q_w8(spark, sf):
    """|relative - 1| > 0.2, top 8 per cluster."""
    return segments.top_distinguishing(_profile(spark, sf), 8, 0.2)


@register("cluster_feature_notes")
def q_w9(spark, sf):
    """W9."""
    return segments.cluster_feature_notes(_profile(spark, sf))


@register("preliminary_labels")
def q_w11(spark, sf):
    """W10 + W11."""
    return segments.preliminary_labels(segments.top_distinguishing(_profile(spark, sf), 8, 0.2))


@register("manual_labels")
def q_w12(spark, sf):
    """W12 on the cluster size table."""
    return segments.manual_labels(segments.cluster_size_summary(_seg(spark, sf)), MANUAL_LABELS)


@register("cluster_profile_rounded")
def q_n9(spark, sf):
    """N9."""
    return segments.cluster_profile_rounded(_seg(spark, sf), SEG_FEATURES)


@register("cluster_sizes_top_models")
def q_n13(spark, sf):
    """N13 for the two labellings."""
    return segments.cluster_sizes_many(_seg(spark, sf), ["cluster", "cluster_ltv"])


# ------------------------------------------------------------------ T1, T6, M, K (exact preparation)
from ..operators import pipeline, prep, split  # noqa: E402

SPLIT_SEED = 2
NOT_FEATURES = ["unique_id", "target", "is_test"]


def split_loans(spark, sf):
    book = staged(fixtures.loan_book(spark, sf).dropDuplicates())
    return split.stratified_split(book, "target", "unique_id", 0.2, SPLIT_SEED)


@register("stratified_split")
def q_t1(spark, sf):
    """20 % test rows per class, chosen by hash(unique_id, seed 2)."""
    return split_loans(spark, sf).select("unique_id", "target", "is_test")


@register("balanced_weights")
def q_t6(spark, sf):
    """T6 on the training rows."""
    tr = split_loans(spark, sf).where(~F.col("is_test"))
    return split.balanced_weights(tr, "target").select("unique_id", "target", "weight")


@register("feature_groups")
def q_m2(spark, sf):
    """M2 on the labelled feature table (target excluded)."""
    return prep.feature_group_table(labelled_features(spark, sf), exclude=[TARGET])


@register("split_target_features")
def q_m3_features(spark, sf):
    """M3: the labelled features without the target."""
    return prep.split_target(labelled_features(spark, sf), TARGET)[0]


@register("split_target_values")
def q_m3_target(spark, sf):
    """M3: the target alone."""
    return prep.split_target(labelled_features(spark, sf), TARGET)[1]


@register("exclude_columns")
def q_k3(spark, sf):
    """K3: the target and an absent column dropped where present."""
    return prep.exclude_columns(labelled_features(spark, sf), [TARGET, "absent"])


@register("ltv_outlier_imputer")
def q_m1(spark, sf):
    """M1 fitted on the training rows, applied to all rows."""
    s = split_loans(spark, sf)
    m = prep.LtvOutlierImputer().fit(s.where(~F.col("is_test")))
    return m.transform(s).select("unique_id", "is_test", "loan_to_value")


@register("median_impute_robust_scale")
def q_m4(spark, sf):
    """M4 on the numeric group, fitted on the training rows."""
    s = split_loans(spark, sf)
    cols = prep.numeric_columns(s, NOT_FEATURES)
    m = prep.MedianImputeRobustScale(cols).fit(s.where(~F.col("is_test")))
    return m.transform(s).select("unique_id", *[f"numeric__{c}" for c in cols])


@register("mode_impute_one_hot")
def q_m5(spark, sf):
    """M5 on the low-cardinality group, fitted on the training rows, as (id, feature, value)."""
    s = split_loans(spark, sf)
    tr = s.where(~F.col("is_test"))
    m = prep.ModeImputeOneHot(prep.feature_groups(tr, exclude=NOT_FEATURES)["low"]).fit(tr)
    out = m.transform(s)
    names = [c for c in out.columns if c.startswith(m.prefix)]
    return out.unpivot(["unique_id"], [f"`{c}`" for c in names], "feature", "value")


@register("target_encode")
def q_m6(spark, sf):
    """M6 on state: out-of-fold encodings for train rows, full-train encodings for test rows."""
    s = split_loans(spark, sf)
    tr, te = s.where(~F.col("is_test")), s.where(F.col("is_test"))
    m = prep.TargetEncoder("state", "target", "unique_id").fit(tr)
    tr_enc = m.transform(split.assign_folds(tr, "target", "unique_id", 5, SPLIT_SEED), train=True)
    te_enc = m.transform(te)
    col = "high_cardinality_categorical__state"
    return tr_enc.select("unique_id", "is_test", col).unionByName(te_enc.select("unique_id", "is_test", col))


@register("prepared_features")
def q_m8(spark, sf):
    """M7 + M8: all rows through the pipeline fitted on the training rows, as (id, feature, value); training rows out of fold."""
    s = split_loans(spark, sf)
    tr = s.where(~F.col("is_test"))
    model = pipeline.preparation_pipeline(tr, "target", "unique_id").fit(tr)
    folded = split.assign_folds(tr, "target", "unique_id", 5, SPLIT_SEED)
    return pipeline.prepared_features(model, folded, "unique_id").unionByName(
        pipeline.prepared_features(model, s.where(F.col("is_test")), "unique_id"))


@register("frequency_encode")
def q_k1(spark, sf):
    """K1 on state, fitted on the training rows."""
    s = split_loans(spark, sf)
    m = prep.FrequencyEncoder("state").fit(s.where(~F.col("is_test")))
    return m.transform(s).select("unique_id", "state", "state_frequency")


@register("quantile_cap")
def q_k2(spark, sf):
    """K2 on the numeric group: clip to the training 1 % / 99 % quantiles."""
    s = split_loans(spark, sf)
    cols = prep.numeric_columns(s, NOT_FEATURES)
    m = prep.QuantileCapper(cols).fit(s.where(~F.col("is_test")))
    return m.transform(s).select("unique_id", *cols)


# ------------------------------------------------------------------ T2-T8, I, CM (Spark ML; no SQL oracle)
from ..operators import clusterers, train  # noqa: E402

_RUNS: dict = {}
CLUSTER_KS = range(3, 7)


def model_table(spark, sf):
    """Labelled features keeping unique_id (the row identity for joins)."""
    raw = fixtures.loans_labelled(spark, sf)
    cleaned = (raw.transform(clean.rename_columns).transform(clean.serial_day_to_date)
               .transform(clean.standardize_missing).transform(clean.drop_duplicate_rows))
    cleaned = staged(clean.drop_noninformative_columns(
        cleaned, [c for c in clean.rules.NONINFORMATIVE_COLUMNS if c != "unique_id"]))
    return features.drop_temporal_columns(features.FeatureEngineer().fit_transform(cleaned))


def training_run(spark, sf):
    key = ("classifiers", spark.sparkContext.applicationId, sf)
    if key not in _RUNS:
        table = model_table(spark, sf)
        _RUNS[key] = (table, train.train_all_models(table, TARGET, "unique_id"))
    return _RUNS[key]


@register("classifier_metrics")
def q_t8(spark, sf):
    """T2-T8 + V8: the four trained classifiers on the test split."""
    _, run = training_run(spark, sf)
    return select.drop_nested_metrics(evaluate.metrics_table(run.scored, 0.5))


@register("trained_best_thresholds")
def q_t8_th(spark, sf):
    """TH4 on the trained classifiers (max_f1)."""
    _, run = training_run(spark, sf)
    return evaluate.select_best_thresholds(evaluate.threshold_sweep(run.scored), "max_f1")


@register("feature_names")
def q_i1(spark, sf):
    """I1."""
    _, run = training_run(spark, sf)
    return train.feature_names_table(spark, run.prepared.feature_names)


@register("logistic_coefficients")
def q_i2(spark, sf):
    """I2 + I8."""
    _, run = training_run(spark, sf)
    name = "logistic_regression_baseline"
    return train.logistic_coefficients(spark, run.models[name], run.prepared.feature_names, name)


@register("top_drivers")
def q_n5(spark, sf):
    """N5."""
    return train.top_drivers(q_i2(spark, sf), 10)


@register("native_importance")
def q_i4(spark, sf):
    """I3 + I4."""
    _, run = training_run(spark, sf)
    return train.native_importance_all(spark, run)


@register("top_importance_per_model")
def q_n6(spark, sf):
    """N6 (top 7) / I7."""
    return train.top_features(q_i4(spark, sf), "importance", 7)


@register("top10_importance_per_model")
def q_n15(spark, sf):
    """The ten most important features of each model, ascending."""
    return train.top_features(q_i4(spark, sf), "importance", 10).orderBy("model", F.desc("rank"))


@register("permutation_importance")
def q_i5(spark, sf):
    """I5 + I6 for every trained model, 5 repeats."""
    table, run = training_run(spark, sf)
    s = split.stratified_split(table, TARGET, "unique_id", 0.2, SPLIT_SEED)
    test = s.where(F.col("is_test")).drop("is_test")
    raw_cols = [c for c in test.columns if c not in ("unique_id", TARGET)]
    return train.permutation_importance(run, test, raw_cols, TARGET, "unique_id", list(run.models), 5)


def clustering_inputs(spark, sf):
    uf = model_table_unlabelled(spark, sf)
    transform, _ = clusterers.clustering_preprocessor(uf, [], "unique_id")
    return transform(uf).select(F.col("unique_id").alias("row_id"), "features")


def model_table_unlabelled(spark, sf):
    raw = fixtures.loans_unlabelled(spark, sf)
    cleaned = (raw.transform(clean.rename_columns).transform(clean.serial_day_to_date)
               .transform(clean.standardize_missing).transform(clean.drop_duplicate_rows))
    cleaned = staged(clean.drop_noninformative_columns(
        cleaned, [c for c in clean.rules.NONINFORMATIVE_COLUMNS if c != "unique_id"]))
    return features.drop_temporal_columns(features.FeatureEngineer().fit_transform(cleaned))


def clustering_run(spark, sf):
    key = ("clusters", spark.sparkContext.applicationId, sf)
    if key not in _RUNS:
        _RUNS[key] = clusterers.fit_clusterers(clustering_inputs(spark, sf), CLUSTER_KS)
    return _RUNS[key]


@register("clustering_features")
def q_k5(spark, sf):
    """K5 on the unlabelled loans, one long (row, position, value) table."""
    return clustering_inputs(spark, sf).select(
        "row_id", F.posexplode(vector_to_array("features")).alias("position", "value"))


def fitted_metrics(spark, sf):
    key = ("cluster metrics", spark.sparkContext.applicationId, sf)
    if key not in _RUNS:
        # one row per model
        _RUNS[key] = cluster_eval.rank_clusterings(clusterers.clusterer_metrics(clustering_run(spark, sf))).checkpoint()
    return _RUNS[key]


@register("cluster_metrics_fitted")
def q_cm8(spark, sf):
    """CM2-CM8: four algorithms x k = 3..6 on the unlabelled loans, ranked."""
    return fitted_metrics(spark, sf)


@register("cluster_sizes_fitted_top3")
def q_n13_fitted(spark, sf):
    """Cluster sizes of the three best fitted models."""
    best = [r["model"] for r in fitted_metrics(spark, sf).where("rank <= 3").orderBy("rank").collect()]
    return segments.cluster_sizes_many(clustering_run(spark, sf).labels_wide(), best)


@register("cluster_labels_wide")
def q_cm9(spark, sf):
    """CM9: one label column per fitted model, one row per loan."""
    return clustering_run(spark, sf).labels_wide()
