"""Oracle SQL per registered query name."""

from __future__ import annotations

from . import profile_sql as P
from .sql import (
    BASE, FEATURE_NUMERIC, FEATURE_STRINGS, FEATURE_TYPES, LOAN_BOOK, RAW_LABELLED, RAW_TYPES, UNLABELLED_FEATURE_TYPES, feature_ctes,
    r, round_cols, sd, with_,
)

TARGET = "target"
BOX_COLUMNS = ["disbursed_amount", "loan_to_value", "fico_score", "current_balance_amount"]
LAB = {c: RAW_TYPES[c] for c in RAW_LABELLED}
UNLAB_BASE = LOAN_BOOK + feature_ctes("loans_unlabelled", "ufeats", unlabelled=True)
DOCS = ["""doc_labels AS (SELECT d.doc_id, lang, source, n_chars, quality, toxic
  FROM documents AS d JOIN labels AS l ON d.doc_id = l.doc_id)"""]
DOC_TYPES = {"doc_id": "bigint", "lang": "string", "source": "string", "n_chars": "bigint",
             "quality": "int", "toxic": "int"}


def _doubles(types: dict[str, str]) -> list[str]:
    return [c for c, t in types.items() if t == "double"]


def _raw(sql_body: str, doubles=None) -> str:
    return round_cols(with_(LOAN_BOOK, sql_body), doubles if doubles is not None else _doubles(LAB))


def _tail(ctes: list[str], tail: str) -> str:
    """CTE list plus a tail that may add more CTEs (starting with ',')."""
    if tail.startswith(","):
        return "WITH " + ",\n".join(ctes) + tail
    return with_(ctes, tail)


SQL: dict[str, str] = {}

SQL["loan_book"] = round_cols(with_(LOAN_BOOK, "SELECT * FROM loan_book"), _doubles(RAW_TYPES))
SQL["rename_columns"] = _raw("SELECT * RENAME (disbursal_date AS disbursement_date) FROM loans_labelled")
SQL["serial_day_to_date"] = _raw(
    "SELECT * REPLACE (DATE '1899-12-30' + CAST(disbursement_date AS INTEGER) AS disbursement_date) "
    "FROM (SELECT * RENAME (disbursal_date AS disbursement_date) FROM loans_labelled) AS t")
SQL["standardize_missing"] = _raw(
    "SELECT * REPLACE (CASE WHEN employment_type IS NULL OR employment_type IN ('Missing', 'missing', '', ' ') "
    "THEN 'Unknown' ELSE employment_type END AS employment_type) FROM loans_labelled")
SQL["drop_duplicate_rows"] = _raw("SELECT DISTINCT * FROM loans_labelled")
SQL["drop_noninformative_columns"] = _raw(
    "SELECT * EXCLUDE (state_id, employee_code_id, mobile_avl_flag, unique_id, voter_id_flag, "
    "sanctioned_amount) FROM loans_labelled",
    [c for c in _doubles(LAB) if c != "sanctioned_amount"])
SQL["preprocess"] = round_cols(
    with_(BASE, "SELECT * FROM feats_clean"),
    [c for c in _doubles(LAB) if c != "sanctioned_amount"])
SQL["build_features"] = round_cols(with_(BASE, "SELECT * FROM feats"), _doubles(FEATURE_TYPES))
SQL["build_features_unlabelled"] = round_cols(
    with_(UNLAB_BASE, "SELECT * FROM ufeats"), _doubles(UNLABELLED_FEATURE_TYPES))

_FICO_RATING = ("CASE WHEN fico_score IS NULL THEN 'Unknown' WHEN fico_score < 300 THEN 'Bureau Excluded' "
                "WHEN fico_score < 580 THEN 'Poor' WHEN fico_score < 670 THEN 'Fair' "
                "WHEN fico_score < 740 THEN 'Good' WHEN fico_score < 800 THEN 'Very Good' "
                "ELSE 'Exceptional' END")
_FICO_ORD = ("CASE WHEN fico_score IS NULL THEN NULL WHEN fico_score < 300 THEN 0 WHEN fico_score < 580 THEN 1 "
             "WHEN fico_score < 670 THEN 2 WHEN fico_score < 740 THEN 3 WHEN fico_score < 800 THEN 4 ELSE 5 END")
SQL["fico_features"] = _raw(f"""SELECT unique_id, fico_score,
  CASE WHEN fico_score < 300 THEN 1 ELSE 0 END AS is_bureau_excluded,
  CASE WHEN fico_score >= 300 THEN CAST(fico_score AS DOUBLE) END AS legit_fico_score,
  {_FICO_RATING} AS fico_rating, {_FICO_ORD} AS fico_rating_ordinal
FROM loan_book""", ["legit_fico_score"])
_POS = "(CASE WHEN current_balance_amount >= 0 THEN CAST(current_balance_amount AS DOUBLE) ELSE 0.0 END)"
SQL["balance_features"] = _raw(f"""SELECT unique_id, current_balance_amount, instalment_amount, disbursed_amount,
  CASE WHEN current_balance_amount < 0 THEN 1 ELSE 0 END AS has_negative_current_balance,
  CASE WHEN current_balance_amount = 0 THEN 1 ELSE 0 END AS has_zero_current_balance,
  {_POS} AS current_balance_positive_amount,
  {sd('instalment_amount', 'disbursed_amount', 1000)} AS instalment_to_disbursed_ratio,
  {sd(_POS, 'disbursed_amount')} AS balance_to_disbursed_ratio
FROM loan_book""", ["current_balance_amount", "instalment_amount", "disbursed_amount",
                    "current_balance_positive_amount", "instalment_to_disbursed_ratio",
                    "balance_to_disbursed_ratio"])
SQL["account_features"] = _raw(f"""SELECT unique_id, number_of_accounts, number_of_active_accounts,
  number_of_overdue_accounts, number_of_accounts_opened_last_6_months, number_of_delinquencies_last_6_months,
  average_account_age, number_of_inquiries,
  CASE WHEN number_of_active_accounts = 0 THEN 1 ELSE 0 END AS has_no_active_accounts,
  {sd('number_of_active_accounts', 'number_of_accounts')} AS active_account_ratio,
  {sd('number_of_overdue_accounts', 'number_of_accounts')} AS overdue_account_ratio,
  {sd('number_of_accounts_opened_last_6_months', 'number_of_accounts')} AS recently_opened_account_ratio,
  {sd('number_of_delinquencies_last_6_months', 'number_of_accounts')} AS recent_delinquency_account_ratio,
  CASE WHEN average_account_age <= 5 THEN 'Very Young' WHEN average_account_age <= 11 THEN 'Young'
       WHEN average_account_age <= 35 THEN 'Established' WHEN average_account_age <= 59 THEN 'Mature'
       WHEN average_account_age IS NOT NULL THEN 'Seasoned' END AS credit_history_age_band,
  {sd('number_of_accounts', 'average_account_age')} AS accounts_per_history_month,
  {sd('number_of_accounts_opened_last_6_months', 'average_account_age')} AS recently_opened_per_history_month,
  CASE WHEN number_of_inquiries <= 0 THEN 'No Inquiry' WHEN number_of_inquiries <= 1 THEN 'Single Inquiry'
       WHEN number_of_inquiries <= 3 THEN 'Moderate Inquiries'
       WHEN number_of_inquiries IS NOT NULL THEN 'High Inquiries' END AS inquiry_intensity_band,
  {sd('number_of_inquiries', 'average_account_age')} AS inquiry_per_history_month,
  {sd('number_of_inquiries', 'number_of_accounts')} AS inquiry_to_account_ratio
FROM loan_book""", ["active_account_ratio", "overdue_account_ratio", "recently_opened_account_ratio",
                    "recent_delinquency_account_ratio", "accounts_per_history_month",
                    "recently_opened_per_history_month", "inquiry_per_history_month",
                    "inquiry_to_account_ratio"])
SQL["ltv_features"] = _raw("""SELECT unique_id, loan_to_value,
  CASE WHEN loan_to_value >= 80 THEN 1 ELSE 0 END AS is_high_ltv,
  CASE WHEN loan_to_value >= 90 THEN 1 ELSE 0 END AS is_very_high_ltv,
  CASE WHEN loan_to_value <= 100 THEN CAST(loan_to_value AS DOUBLE) END AS legit_ltv
FROM loan_book""", ["loan_to_value", "legit_ltv"])

# ---------------------------------------------------------------- profiling
F_TYPES = FEATURE_TYPES
SQL["compare_columns"] = _tail(BASE, P.compare_columns("loans_labelled", RAW_LABELLED, "feats", list(F_TYPES)))
SQL["compare_columns_unlabelled"] = _tail(UNLAB_BASE, P.compare_columns(
    "loans_unlabelled", [c for c in RAW_TYPES if c != "target"], "ufeats", list(UNLABELLED_FEATURE_TYPES)))
SQL["split_target_features"] = round_cols(with_(BASE, f'SELECT * EXCLUDE ("{TARGET}") FROM feats'),
                                          [c for c in _doubles(FEATURE_TYPES) if c != TARGET])
SQL["split_target_values"] = with_(BASE, f'SELECT "{TARGET}" FROM feats')
SQL["exclude_columns"] = SQL["split_target_features"]
SQL["dataframe_overview"] = _tail(BASE, P.overview("feats", F_TYPES))
SQL["duplicate_summary"] = with_(LOAN_BOOK, P.duplicate_summary("loans_labelled", RAW_LABELLED, "unique_id"))
SQL["missing_summary"] = _tail(BASE, P.missing_summary("feats", list(F_TYPES)))
SQL["constant_columns"] = _tail(LOAN_BOOK, P.constant_columns("loans_labelled", RAW_LABELLED))
SQL["target_summary"] = with_(BASE, P.target_summary("feats", TARGET))
SQL["numeric_summary"] = with_(BASE, P.numeric_summary("feats", F_TYPES))
SQL["negative_numeric_summary"] = with_(BASE, P.negative_numeric_summary("feats", F_TYPES))
SQL["categorical_summary"] = with_(BASE, P.categorical_summary("feats", F_TYPES, 10))
SQL["rate_by_category"] = with_(BASE, P.rate_by_category(
    "feats", [c for c, t in F_TYPES.items() if t == "string"], TARGET, 10))
SQL["rate_by_category_documents"] = with_(DOCS, P.rate_by_category("doc_labels", ["lang", "source"], "toxic", 25))
_BIN_COLS = [c for c in P._numeric(F_TYPES, [TARGET])]
SQL["rate_by_quantile_bin"] = _tail(BASE, P.binned_rates("feats", _BIN_COLS, TARGET, 5, "quantile"))
SQL["rate_by_uniform_bin"] = _tail(BASE, P.binned_rates("feats", _BIN_COLS, TARGET, 5, "uniform"))
SQL["outlier_summary"] = with_(BASE, P.outlier_summary("feats", F_TYPES, 0.05, 0.95))
SQL["correlated_pairs"] = _tail(BASE, P.correlated_pairs("feats", F_TYPES, TARGET, 0.8))
SQL["target_correlation"] = _tail(BASE, P.target_correlation("feats", F_TYPES, TARGET))
SQL["correlated_pairs_with_target"] = _tail(BASE, P.correlated_pairs_with_target("feats", F_TYPES, TARGET, 0.8))
SQL["missing_rate_top_n"] = _tail(LOAN_BOOK, P.missing_rate_top_n("loans_labelled", RAW_LABELLED, 20))
SQL["target_distribution"] = with_(BASE, P.target_distribution("feats", TARGET))
SQL["boxplot_stats"] = with_(BASE, P.boxplot_stats("feats", BOX_COLUMNS))
SQL["correlation_matrix"] = _tail(BASE, P.correlation_matrix("feats", F_TYPES))
SQL["duplicated_rows"] = _raw(P.duplicated_rows("loans_labelled", RAW_LABELLED, RAW_LABELLED))
SQL["duplicated_ids"] = _raw(P.duplicated_rows("loans_labelled", RAW_LABELLED, ["unique_id"]))
SQL["missing_rate_table"] = _tail(UNLAB_BASE, P.missing_rate_table("ufeats", list(UNLABELLED_FEATURE_TYPES), 10))
SQL["quantile_spread"] = with_(UNLAB_BASE, P.quantile_spread("ufeats", UNLABELLED_FEATURE_TYPES, 20))

__all__ = ["SQL", "r"]


# ---------------------------------------------------------------- evaluation on `scored`
SCORED = LOAN_BOOK + [
    """sb AS (SELECT DISTINCT unique_id, fico_score, number_of_overdue_accounts, number_of_accounts, target
  FROM loan_book)""",
    """scored AS (
  SELECT unique_id AS row_id, target AS y, 'linear' AS model,
    least(CAST(1.0 AS DOUBLE), CAST(855 - fico_score AS DOUBLE) / CAST(1222.0 AS DOUBLE)
          + CAST(0.1 AS DOUBLE) * number_of_overdue_accounts) AS score FROM sb
  UNION ALL
  SELECT unique_id, target, 'ratio',
    coalesce(CAST(number_of_overdue_accounts AS DOUBLE) / nullif(CAST(number_of_accounts AS DOUBLE), 0), 0.0)
  FROM sb)""",
    """cum AS (
  SELECT model, score, pos, neg,
    sum(pos) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
    sum(neg) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
    sum(pos) OVER (PARTITION BY model) AS "P", sum(neg) OVER (PARTITION BY model) AS "N"
  FROM (SELECT model, score, CAST(sum(y) AS BIGINT) AS pos, CAST(count(*) - sum(y) AS BIGINT) AS neg
        FROM scored GROUP BY model, score) AS g)""",
    """areas AS (
  SELECT model, sum(neg * (tp - pos / 2.0)) / (CAST(any_value("P") AS DOUBLE) * any_value("N")) AS roc_auc,
    sum(pos * tp / (tp + fp)) / CAST(any_value("P") AS DOUBLE) AS pr_auc
  FROM cum GROUP BY model)""",
    """cc AS (
  SELECT model, count(*) FILTER (WHERE score < 0.5 AND y <> 1) AS tn,
    count(*) FILTER (WHERE score >= 0.5 AND y <> 1) AS fp,
    count(*) FILTER (WHERE score < 0.5 AND y = 1) AS fn,
    count(*) FILTER (WHERE score >= 0.5 AND y = 1) AS tp
  FROM scored GROUP BY model)""",
]


def _rt(num: str, den: str) -> str:
    return f"coalesce(CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0), 0.0)"


def _metric_cols(tp="tp", tn="tn", fp="fp", fn="fn") -> str:
    n = f"({tp} + {tn} + {fp} + {fn})"
    rec, spec = _rt(tp, f"{tp} + {fn}"), _rt(tn, f"{tn} + {fp}")
    return (f"{_rt(f'{tp} + {tn}', n)} AS accuracy, ({rec} + {spec}) / 2.0 AS balanced_accuracy, "
            f"{_rt(tp, f'{tp} + {fp}')} AS precision, {rec} AS recall, "
            f"{_rt(f'2 * {tp}', f'2 * {tp} + {fp} + {fn}')} AS f1_score, "
            f"{tp} AS true_positive, {tn} AS true_negative, {fp} AS false_positive, {fn} AS false_negative, "
            f"{_rt(f'{tp} + {fp}', n)} AS predicted_positive_rate")


def _sweep(grid_lo: int, grid_hi: int, model_filter: str = "") -> str:
    return f"""sweep AS (
  SELECT threshold, {_metric_cols()}, model FROM (
    SELECT g.threshold, s.model,
      count(*) FILTER (WHERE s.score >= g.threshold AND s.y = 1) AS tp,
      count(*) FILTER (WHERE s.score >= g.threshold AND s.y <> 1) AS fp,
      count(*) FILTER (WHERE s.score < g.threshold AND s.y = 1) AS fn,
      count(*) FILTER (WHERE s.score < g.threshold AND s.y <> 1) AS tn
    FROM scored AS s, (SELECT i / 20 AS threshold FROM range({grid_lo}, {grid_hi}) AS t(i)) AS g
    {model_filter}
    GROUP BY g.threshold, s.model) AS c)"""


def _best(strategy_cols: list[str], where: str = "") -> str:
    order = ", ".join(f"{c} DESC" for c in strategy_cols)
    return f"""best AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY model ORDER BY {order}, threshold ASC) AS rn
    FROM sweep {where}) AS t WHERE rn = 1)"""


_METRICS_TABLE = f"""metrics AS (
  SELECT cc.model, 0.5 AS threshold, {_metric_cols()}, areas.roc_auc, areas.pr_auc,
    [[tn, fp], [fn, tp]] AS confusion_matrix
  FROM cc JOIN areas ON cc.model = areas.model)"""
_METRIC_ORDER = ["accuracy", "balanced_accuracy", "precision", "recall", "f1_score", "roc_auc", "pr_auc",
                 "true_positive", "true_negative", "false_positive", "false_negative",
                 "predicted_positive_rate"]
_SWEEP_COLS = ["threshold", "accuracy", "balanced_accuracy", "precision", "recall", "f1_score",
               "true_positive", "true_negative", "false_positive", "false_negative", "predicted_positive_rate"]
_SELECTION = with_(SCORED + [_METRICS_TABLE, _sweep(1, 19), _best(["f1_score", "precision", "recall"]),
                             """sel AS (
  SELECT m.* EXCLUDE (confusion_matrix), """ + ", ".join(f"b.{c} AS selected_{c}" for c in _SWEEP_COLS) + """,
    CASE WHEN m.model LIKE '%logistic_regression%' THEN 'Explainable baseline'
         WHEN m.model LIKE '%decision_tree%' THEN 'Interpretable non-linear benchmark'
         WHEN m.model LIKE '%random_forest%' THEN 'Tree ensemble benchmark'
         WHEN m.model LIKE '%gradient_boosting%' THEN 'Boosting benchmark'
         ELSE 'Candidate model' END AS model_role
  FROM metrics AS m LEFT JOIN best AS b ON m.model = b.model)"""], "{body}")
_RANK = ("row_number() OVER (ORDER BY pr_auc DESC NULLS LAST, selected_f1_score DESC NULLS LAST, "
         "selected_recall DESC NULLS LAST, selected_precision DESC NULLS LAST, roc_auc DESC NULLS LAST, "
         "model ASC)::INTEGER AS rank")

SQL["predict_at_threshold"] = with_(SCORED, "SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction "
                                            "FROM scored")
SQL["predict_at_threshold"] = round_cols(SQL["predict_at_threshold"], ["score"])
SQL["confusion_counts"] = with_(SCORED, "SELECT * FROM cc")
SQL["threshold_metrics"] = round_cols(with_(SCORED, f"SELECT model, {_metric_cols()} FROM cc"),
                                      ["accuracy", "balanced_accuracy", "precision", "recall", "f1_score",
                                       "predicted_positive_rate"])
SQL["roc_pr_auc"] = round_cols(with_(SCORED, "SELECT * FROM areas"), ["roc_auc", "pr_auc"])
SQL["metrics_table"] = round_cols(with_(SCORED + [_METRICS_TABLE], "SELECT * FROM metrics"),
                                  ["threshold", "accuracy", "balanced_accuracy", "precision", "recall",
                                   "f1_score", "roc_auc", "pr_auc", "predicted_positive_rate"])
SQL["classification_report"] = round_cols(with_(SCORED, f"""
SELECT model, label, precision, recall, f1_score, support FROM (
  SELECT model, '0' AS label, {_rt('tn', 'tn + fn')} AS precision, {_rt('tn', 'tn + fp')} AS recall,
    {_rt('2 * tn', '2 * tn + fn + fp')} AS f1_score, tn + fp AS support FROM cc
  UNION ALL
  SELECT model, '1', {_rt('tp', 'tp + fp')}, {_rt('tp', 'tp + fn')}, {_rt('2 * tp', '2 * tp + fp + fn')}, tp + fn FROM cc
  UNION ALL
  SELECT model, 'accuracy', NULL, NULL, {_rt('tp + tn', 'tp + tn + fp + fn')}, tp + tn + fp + fn FROM cc
  UNION ALL
  SELECT model, 'macro avg', ({_rt('tn', 'tn + fn')} + {_rt('tp', 'tp + fp')}) / 2,
    ({_rt('tn', 'tn + fp')} + {_rt('tp', 'tp + fn')}) / 2,
    ({_rt('2 * tn', '2 * tn + fn + fp')} + {_rt('2 * tp', '2 * tp + fp + fn')}) / 2, tp + tn + fp + fn FROM cc
  UNION ALL
  SELECT model, 'weighted avg',
    ({_rt('tn', 'tn + fn')} * (tn + fp) + {_rt('tp', 'tp + fp')} * (tp + fn)) / (tp + tn + fp + fn),
    ({_rt('tn', 'tn + fp')} * (tn + fp) + {_rt('tp', 'tp + fn')} * (tp + fn)) / (tp + tn + fp + fn),
    ({_rt('2 * tn', '2 * tn + fn + fp')} * (tn + fp) + {_rt('2 * tp', '2 * tp + fp + fn')} * (tp + fn))
      / (tp + tn + fp + fn), tp + tn + fp + fn FROM cc) AS t"""), ["precision", "recall", "f1_score"])
_SWEEP_DOUBLES = ["threshold", "accuracy", "balanced_accuracy", "precision", "recall", "f1_score",
                  "predicted_positive_rate"]
SQL["threshold_sweep"] = round_cols(with_(SCORED + [_sweep(1, 19)], "SELECT * FROM sweep"), _SWEEP_DOUBLES)
SQL["best_thresholds_max_f1"] = round_cols(
    with_(SCORED + [_sweep(1, 19), _best(["f1_score", "precision", "recall"])], "SELECT * FROM best"),
    _SWEEP_DOUBLES)
SQL["best_thresholds_max_precision_recall70"] = round_cols(
    with_(SCORED + [_sweep(1, 19), _best(["precision", "recall", "f1_score"], "WHERE recall >= 0.70")],
          "SELECT * FROM best"), _SWEEP_DOUBLES)
_SEL_DOUBLES = (["threshold", "accuracy", "balanced_accuracy", "precision", "recall", "f1_score", "roc_auc",
                 "pr_auc", "predicted_positive_rate"] + [f"selected_{c}" for c in _SWEEP_DOUBLES])
SQL["model_selection_table"] = round_cols(_SELECTION.format(body=f"SELECT *, {_RANK} FROM sel"), _SEL_DOUBLES)
SQL["final_model"] = round_cols(_SELECTION.format(
    body=f"SELECT * FROM (SELECT *, {_RANK} FROM sel WHERE selected_recall >= 0.5) AS t WHERE rank = 1"),
    _SEL_DOUBLES)
SQL["threshold_sensitivity"] = round_cols(with_(SCORED + [_sweep(5, 16, "WHERE s.model = 'linear'")], """
SELECT model, threshold, true_positive, true_negative, false_positive, false_negative, precision, recall,
  predicted_positive_rate FROM sweep"""), ["threshold", "precision", "recall", "predicted_positive_rate"])
SQL["roc_curve_points"] = round_cols(with_(SCORED, """
SELECT model, score AS threshold, CAST(fp AS DOUBLE) / "N" AS fpr, CAST(tp AS DOUBLE) / "P" AS tpr FROM cum"""),
    ["threshold", "fpr", "tpr"])
SQL["pr_curve_points"] = round_cols(with_(SCORED, """
SELECT model, score AS threshold, CAST(tp AS DOUBLE) / "P" AS recall, CAST(tp AS DOUBLE) / (tp + fp) AS precision
FROM cum"""), ["threshold", "recall", "precision"])
SQL["confusion_matrix_table"] = with_(SCORED, """
SELECT model, y AS actual, count(*) FILTER (WHERE score < 0.5) AS predicted_0,
  count(*) FILTER (WHERE score >= 0.5) AS predicted_1
FROM scored GROUP BY model, y""")
SQL["models_ranked_by_metric"] = round_cols(with_(SCORED + [_METRICS_TABLE], """
SELECT model, metric, value, row_number() OVER (PARTITION BY metric ORDER BY value DESC, model)::INTEGER AS rank
FROM (UNPIVOT (SELECT model, CAST(roc_auc AS DOUBLE) AS roc_auc, CAST(pr_auc AS DOUBLE) AS pr_auc,
         CAST(f1_score AS DOUBLE) AS f1_score, CAST(precision AS DOUBLE) AS precision,
         CAST(recall AS DOUBLE) AS recall, CAST(balanced_accuracy AS DOUBLE) AS balanced_accuracy
       FROM metrics) ON roc_auc, pr_auc, f1_score, precision, recall, balanced_accuracy
       INTO NAME metric VALUE value) AS u"""), ["value"])


# ---------------------------------------------------------------- clustering evaluation
from . import cluster_sql as X  # noqa: E402

_CM = X.metrics_ctes()
SQL["assigned_cluster_count"] = "SELECT count(DISTINCT label) AS n_assigned_clusters FROM embeddings"
SQL["cluster_covering_sample"] = with_([X.assigned_cte("a3", 3)] + X.sample_ctes("a3", "smp", 100),
                                       "SELECT row_id, features, cluster FROM smp")
SQL["silhouette"] = round_cols(with_([X.assigned_cte("a3", 3)] + X.sample_ctes("a3", "smp", 10_000)
                                     + [X.silhouette_cte("smp", "sil")], "SELECT * FROM sil"),
                               ["silhouette_score"])
SQL["cluster_size_stats"] = round_cols(with_([X.assigned_cte("a10", None)], """
SELECT map_from_entries(list(struct_pack(k := cluster, v := n) ORDER BY cluster)) AS cluster_sizes,
  CAST(sum(n) AS BIGINT) AS n_observations, count(*) AS n_assigned_clusters,
  min(n) AS min_cluster_count, min(n) / sum(n) AS min_cluster_share, max(n) / sum(n) AS max_cluster_share
FROM (SELECT cluster, count(*) AS n FROM a10 GROUP BY cluster) AS t"""), ["min_cluster_share", "max_cluster_share"])
SQL["davies_bouldin_calinski"] = round_cols(with_([X.assigned_cte("a3", 3)] + X.eval_ctes("a3", "ev", "m", 3),
                                                  "SELECT * FROM ev_scores"),
                                            ["davies_bouldin_score", "calinski_harabasz_score", "inertia"])
SQL["clustering_metrics"] = round_cols(with_(_CM, "SELECT * FROM cmetrics"), X.METRIC_DOUBLES)
SQL["rank_clusterings"] = round_cols(with_(_CM, f"SELECT *, {X.RANK} FROM cmetrics"), X.METRIC_DOUBLES)
SQL["valid_clusterings"] = round_cols(with_(_CM, "SELECT * FROM cmetrics WHERE is_valid_clustering"),
                                      X.METRIC_DOUBLES)
SQL["silhouette_curve"] = with_(_CM, X.curve("silhouette_score"))
SQL["inertia_elbow_curve"] = with_(_CM, X.curve("inertia"))
SQL["promising_models"] = round_cols(with_(_CM, f"SELECT * FROM (SELECT *, {X.RANK} FROM cmetrics) AS t "
                                                "WHERE rank <= 3"), X.METRIC_DOUBLES)


# ---------------------------------------------------------------- separation and segment profiles
from . import segment_sql  # noqa: E402

SQL.update(segment_sql.build())


# ---------------------------------------------------------------- split and preparation
SPLIT = LOAN_BOOK + ["""spl AS (
  SELECT *, rn <= floor(n_c * 0.2 + 0.5) AS is_test FROM (
    SELECT *, row_number() OVER (PARTITION BY target ORDER BY md5(CAST(unique_id AS VARCHAR) || '|2'), unique_id) AS rn,
      count(*) OVER (PARTITION BY target) AS n_c
    FROM (SELECT DISTINCT * FROM loan_book) AS d) AS t)""", "tr AS (SELECT * FROM spl WHERE NOT is_test)"]
SQL["stratified_split"] = with_(SPLIT, "SELECT unique_id, target, is_test FROM spl")
SQL["balanced_weights"] = round_cols(with_(SPLIT, """
SELECT unique_id, target, (SELECT count(*) FROM tr) / (2.0 * count(*) OVER (PARTITION BY target)) AS weight FROM tr"""),
    ["weight"])
SQL["ltv_outlier_imputer"] = round_cols(with_(SPLIT + ["""b AS (SELECT quantile_cont(loan_to_value, 0.01) AS lo,
  quantile_cont(loan_to_value, 0.99) AS hi, quantile_cont(loan_to_value, 0.5) AS med FROM tr)"""], """
SELECT unique_id, is_test, CASE WHEN loan_to_value < lo OR loan_to_value > hi THEN med
  ELSE CAST(loan_to_value AS DOUBLE) END AS loan_to_value FROM spl, b"""), ["loan_to_value"])
_SC = [c for c, t in RAW_TYPES.items() if t != "string" and c not in ("unique_id", "target")]
SQL["median_impute_robust_scale"] = round_cols(with_(SPLIT + ["b AS (SELECT " + ", ".join(
    f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS m_{i}, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS a_{i}, "
    f"quantile_cont(CAST({c} AS DOUBLE), 0.75) AS z_{i}" for i, c in enumerate(_SC)) + " FROM tr)"],
    "SELECT unique_id, " + ", ".join(
        f"(coalesce(CAST({c} AS DOUBLE), m_{i}) - m_{i}) / (CASE WHEN z_{i} - a_{i} = 0 THEN 1.0 ELSE z_{i} - a_{i} END)"
        f" AS numeric__{c}" for i, c in enumerate(_SC)) + " FROM spl, b"), [f"numeric__{c}" for c in _SC])
_CATS = [c for c, t in RAW_TYPES.items() if t == "string"]
_LONG = " UNION ALL ".join(f"SELECT unique_id, is_test, '{c}' AS col, {c} AS v FROM spl" for c in _CATS)
SQL["mode_impute_one_hot"] = with_(SPLIT + [f"lg AS ({_LONG})", """low AS (
  SELECT col FROM lg WHERE NOT is_test AND col <> 'state' GROUP BY col HAVING count(DISTINCT v) < 10)""", """cat AS (
  SELECT col, v AS c, row_number() OVER (PARTITION BY col ORDER BY count(*) DESC, v) AS place
  FROM lg WHERE NOT is_test AND v IS NOT NULL AND col IN (SELECT col FROM low) GROUP BY col, v)"""], """
SELECT unique_id, 'low_cardinality_categorical__' || lg.col || '_' || cat.c AS feature,
  CASE WHEN coalesce(lg.v, m.c) = cat.c THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value
FROM lg JOIN cat ON lg.col = cat.col JOIN cat AS m ON m.col = lg.col AND m.place = 1""")
_TE = ["mo AS (SELECT coalesce(state, '') AS m FROM tr WHERE state IS NOT NULL GROUP BY state ORDER BY count(*) DESC, state LIMIT 1)",
       """tf AS (SELECT unique_id, coalesce(state, m) AS value, CAST(target AS DOUBLE) AS y,
  (row_number() OVER (PARTITION BY target ORDER BY md5(CAST(unique_id AS VARCHAR) || '|3'), unique_id) - 1) % 5 AS fold FROM tr, mo)""",
       "al AS (SELECT count(*) AS tn, sum(y) AS ts, sum(y * y) AS tss FROM tf)",
       "ct AS (SELECT value, count(*) AS n, sum(y) AS s, sum(y * y) AS ss FROM tf GROUP BY value)",
       "fo AS (SELECT fold, count(*) AS fn, sum(y) AS fs, sum(y * y) AS fss FROM tf GROUP BY fold)",
       """parts AS (
  SELECT value, CAST(NULL AS BIGINT) AS fold, n, s, ss, tn AS an, ts AS a_s, tss AS ass FROM ct, al
  UNION ALL SELECT ct.value, fo.fold, ct.n - coalesce(p.n, 0), ct.s - coalesce(p.s, 0), ct.ss - coalesce(p.ss, 0),
    tn - fn, ts - fs, tss - fss
  FROM ct CROSS JOIN fo CROSS JOIN al
  LEFT JOIN (SELECT value, fold, count(*) AS n, sum(y) AS s, sum(y * y) AS ss FROM tf GROUP BY value, fold) AS p
    ON p.value = ct.value AND p.fold = fo.fold)""",
       """moments AS (SELECT value, fold, n, s / nullif(n, 0) AS mc, greatest(ss / nullif(n, 0) - (s / nullif(n, 0)) * (s / nullif(n, 0)), 0) AS vc,
  a_s / an AS ma, ass / an - (a_s / an) * (a_s / an) AS va FROM parts)""",
       """enc AS (SELECT value, fold, CASE WHEN n = 0 THEN ma ELSE
  coalesce(va * n / nullif(va * n + vc, 0), 0) * mc + (1 - coalesce(va * n / nullif(va * n + vc, 0), 0)) * ma END AS e FROM moments)""",
       """te AS (
  SELECT tf.unique_id, enc.e FROM tf JOIN enc ON enc.value = tf.value AND enc.fold = tf.fold
  UNION ALL SELECT spl.unique_id, coalesce(enc.e, ts / tn) FROM spl CROSS JOIN mo CROSS JOIN al
    LEFT JOIN enc ON enc.value = coalesce(state, m) AND enc.fold IS NULL WHERE is_test)"""]
SQL["target_encode"] = round_cols(with_(SPLIT + _TE, """
SELECT spl.unique_id, is_test, e AS high_cardinality_categorical__state FROM spl JOIN te ON te.unique_id = spl.unique_id"""),
    ["high_cardinality_categorical__state"])
# M1, then M4 on its result, M5 and M6, as one long table
_LTV = ["lb AS (SELECT quantile_cont(loan_to_value, 0.01) AS lo, quantile_cont(loan_to_value, 0.99) AS hi, quantile_cont(loan_to_value, 0.5) AS med FROM tr)",
        """ps AS (SELECT spl.* REPLACE (CASE WHEN loan_to_value < lo OR loan_to_value > hi THEN med
  ELSE CAST(loan_to_value AS DOUBLE) END AS loan_to_value) FROM spl, lb)"""]
_NUM = " UNION ALL ".join(f"SELECT unique_id, is_test, '{c}' AS col, CAST({c} AS DOUBLE) AS x FROM ps" for c in _SC)
SQL["prepared_features"] = round_cols(with_(SPLIT + _LTV + _TE + [f"nu AS ({_NUM})", """nq AS (
  SELECT col, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS z FROM nu WHERE NOT is_test GROUP BY col)""",
    f"oh AS ({SQL['mode_impute_one_hot']})"], """
SELECT unique_id, 'numeric__' || col AS feature, (coalesce(x, m) - m) / (CASE WHEN z - a = 0 THEN 1.0 ELSE z - a END) AS value
FROM nu JOIN nq USING (col)
UNION ALL SELECT unique_id, feature, value FROM oh
UNION ALL SELECT unique_id, 'high_cardinality_categorical__state', e FROM te"""), ["value"])
SQL["frequency_encode"] = round_cols(with_(SPLIT + ["""fq AS (
  SELECT coalesce(state, 'Unknown') AS value, count(*) / sum(count(*)) OVER () AS freq FROM tr GROUP BY 1)"""], """
SELECT unique_id, state, coalesce(freq, 0.0) AS state_frequency FROM spl LEFT JOIN fq ON coalesce(state, 'Unknown') = fq.value"""),
    ["state_frequency"])
SQL["quantile_cap"] = round_cols(with_(SPLIT + ["b AS (SELECT " + ", ".join(
    f"quantile_cont(CAST({c} AS DOUBLE), 0.01) AS lo_{i}, quantile_cont(CAST({c} AS DOUBLE), 0.99) AS hi_{i}"
    for i, c in enumerate(_SC)) + " FROM tr)"],
    "SELECT unique_id, " + ", ".join(
        f"CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest(CAST({c} AS DOUBLE), lo_{i}), hi_{i}) END AS {c}"
        for i, c in enumerate(_SC)) + " FROM spl, b"), _SC)
SQL["feature_groups"] = with_(BASE, """
SELECT col AS "column", CASE WHEN col <> 'state' AND count(DISTINCT v) < 10 THEN 'low_cardinality_categorical'
  ELSE 'high_cardinality_categorical' END AS feature_group FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS col, {c} AS v FROM feats" for c in FEATURE_STRINGS) + """) AS t GROUP BY col
UNION ALL SELECT * FROM (VALUES """ + ", ".join(
    f"('{c}', 'numeric')" for c in FEATURE_NUMERIC if c != "target") + ") AS n(col, feature_group)")
