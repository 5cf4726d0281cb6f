"""DuckDB SQL for cluster separation and segment profiles (P, W, N9, N13)."""

from __future__ import annotations

from .sql import LOAN_BOOK, RAW_TYPES, r, round_cols, with_

SEG = LOAN_BOOK + ["""seg AS (
  SELECT *, CASE WHEN fico_score < 400 THEN 0 WHEN fico_score < 600 THEN 1 ELSE 2 END AS cluster,
    CASE WHEN loan_to_value IS NULL THEN 0 WHEN loan_to_value < 80 THEN 1 ELSE 2 END AS cluster_ltv
  FROM (SELECT DISTINCT * FROM loan_book) AS d)"""]
SEG_EXCLUDE = ["unique_id", "target", "cluster", "cluster_ltv"]
SEG_FEATURES = ["fico_score", "loan_to_value", "disbursed_amount", "current_balance_amount",
                "number_of_accounts", "number_of_overdue_accounts", "number_of_inquiries", "age",
                "average_account_age"]
SEG_CATEGORICAL = ["employment_type", "state"]
SEP_NUMERIC = [c for c, t in RAW_TYPES.items() if t != "string" and c not in SEG_EXCLUDE]


def _union(parts):
    return "\nUNION ALL\n".join(parts)


def separation_ctes(labels: list[str]) -> list[str]:
    usable = _union([f"SELECT '{c}' AS feature FROM seg HAVING count(DISTINCT CAST(\"{c}\" AS DOUBLE)) > 1"
                     for c in SEP_NUMERIC])
    med = ", ".join(f"quantile_cont(CAST(\"{c}\" AS DOUBLE), 0.5) AS m_{i}" for i, c in enumerate(SEP_NUMERIC))
    longs = _union([f"SELECT '{lab}' AS model, {lab} AS cluster, '{c}' AS feature, "
                    f"coalesce(CAST(\"{c}\" AS DOUBLE), med.m_{i}) AS value FROM seg, med"
                    for lab in labels for i, c in enumerate(SEP_NUMERIC)])
    return [
        f"usable AS ({usable})",
        f"med AS (SELECT {med} FROM seg)",
        f"slong AS (SELECT * FROM ({longs}) AS l WHERE feature IN (SELECT feature FROM usable))",
        """sper AS (SELECT model, feature, cluster, count(*) AS n_c, avg(value) AS mean_c, var_samp(value) AS var_c
  FROM slong GROUP BY model, feature, cluster)""",
        """sglob AS (SELECT model, feature, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std
  FROM slong GROUP BY model, feature)""",
        """sstats AS (
  SELECT p.model, p.feature, any_value(g.n) AS n, count(*) AS k, any_value(g.std) AS std,
    sum(n_c * (mean_c - g.mean) * (mean_c - g.mean)) AS ssb,
    sum(coalesce(var_c, 0.0) * (n_c - 1)) AS ssw,
    min(mean_c) AS mn, max(mean_c) AS mx,
    first(cluster ORDER BY mean_c ASC, cluster ASC) AS cmin,
    first(cluster ORDER BY mean_c DESC, cluster ASC) AS cmax,
    max(abs(mean_c - g.mean)) AS max_abs_dev
  FROM sper AS p JOIN sglob AS g ON p.model = g.model AND p.feature = g.feature
  GROUP BY p.model, p.feature)""",
        """sep AS (
  SELECT model, feature,
    CASE WHEN ssb + ssw > 0 THEN ssb / (ssb + ssw) END AS eta_squared,
    mn AS cluster_mean_min, mx AS cluster_mean_max, mx - mn AS cluster_mean_range,
    cmin AS cluster_with_min_mean, cmax AS cluster_with_max_mean,
    CASE WHEN std > 0 THEN max_abs_dev / std END AS max_abs_standardized_cluster_mean,
    CASE WHEN k > 1 AND n > k AND ssw > 0 THEN (ssb / (k - 1)) / (ssw / (n - k)) END AS anova_f_score
  FROM sstats)""",
    ]


SEP_DOUBLES = ["eta_squared", "cluster_mean_min", "cluster_mean_max", "cluster_mean_range",
               "max_abs_standardized_cluster_mean", "anova_f_score"]
SEP_RANK = (f"CAST(row_number() OVER (PARTITION BY model ORDER BY {r('eta_squared')} DESC NULLS LAST, "
            f"{r('anova_f_score')} DESC NULLS LAST, {r('max_abs_standardized_cluster_mean')} DESC NULLS LAST, "
            "feature) AS INTEGER) AS rank")


def _long(features, label="cluster", where_not_null=True):
    return _union([f"SELECT {label} AS cluster, '{c}' AS feature, CAST(\"{c}\" AS DOUBLE) AS value FROM seg"
                   for c in features])


PROFILE = [f"wlong AS ({_long(SEG_FEATURES)})",
           """wprof AS (
  SELECT p.cluster, p.feature, p.cluster_mean, g.portfolio_mean,
    p.cluster_mean - g.portfolio_mean AS signed_difference,
    abs(p.cluster_mean - g.portfolio_mean) AS absolute_difference,
    CASE WHEN g.portfolio_mean <> 0 THEN p.cluster_mean / g.portfolio_mean END AS relative_to_portfolio
  FROM (SELECT cluster, feature, avg(value) AS cluster_mean FROM wlong GROUP BY cluster, feature) AS p
  JOIN (SELECT feature, avg(value) AS portfolio_mean FROM wlong GROUP BY feature) AS g ON p.feature = g.feature)""",
           """wdist AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY cluster ORDER BY abs_relative_distance_from_portfolio DESC,
                                       feature) AS INTEGER) AS rank
    FROM (SELECT *, relative_to_portfolio - 1 AS signed_relative_distance_from_portfolio,
            abs(relative_to_portfolio - 1) AS abs_relative_distance_from_portfolio FROM wprof) AS a
    WHERE abs_relative_distance_from_portfolio > 0.2) AS b
  WHERE rank <= 8)"""]
PROFILE_DOUBLES = ["cluster_mean", "portfolio_mean", "signed_difference", "absolute_difference",
                   "relative_to_portfolio"]


def note_case(col: str, rules) -> str:
    norm = f"replace(lower({col}), '_', ' ')"
    parts = []
    for keys, value in rules:
        cond = " OR ".join(f"contains({norm}, '{k}')" for k in keys)
        parts.append(f"WHEN {cond} THEN '{value}'")
    return "CASE " + " ".join(parts) + " ELSE 'Requires manual business review' END"


def segment_label_case(notes: str, rules) -> str:
    parts = []
    for keys, value in rules:
        cond = " OR ".join(f"len(list_filter({notes}, lambda n: contains(lower(n), '{k}'))) > 0" for k in keys)
        parts.append(f"WHEN {cond} THEN '{value}'")
    return "CASE " + " ".join(parts) + " ELSE 'General portfolio segment' END"


def build() -> dict[str, str]:
    from ..functions import rules
    S: dict[str, str] = {}
    all_cols = ", ".join(f'b."{c}"' for c in RAW_TYPES)
    S["attach_labels"] = round_cols(with_(SEG, f"""
SELECT {all_cols}, s.cluster FROM (SELECT DISTINCT * FROM loan_book) AS b
LEFT JOIN (SELECT unique_id, cluster FROM seg) AS s ON b.unique_id = s.unique_id"""),
        [c for c, t in RAW_TYPES.items() if t == "double"])
    S["separation_analysis"] = round_cols(with_(SEG + separation_ctes(["cluster"]),
                                                "SELECT * EXCLUDE (model) FROM sep"), SEP_DOUBLES)
    S["separation_many"] = round_cols(with_(SEG + separation_ctes(["cluster", "cluster_ltv"]),
                                            "SELECT * FROM sep"), SEP_DOUBLES)
    S["top_separating_features"] = round_cols(with_(SEG + separation_ctes(["cluster", "cluster_ltv"]),
        f"SELECT * FROM (SELECT *, {SEP_RANK} FROM sep WHERE model = 'cluster') AS t WHERE rank <= 15"),
        SEP_DOUBLES)
    S["profile_features"] = with_(SEG + separation_ctes(["cluster"]), f"""
SELECT feature, CAST(min(position) AS INTEGER) AS position FROM (
  SELECT * FROM (VALUES ('fico_score', 0), ('loan_to_value', 1), ('number_of_overdue_accounts', 2)) AS d(feature, position)
  UNION ALL
  SELECT feature, 3 + rank FROM (SELECT feature, {SEP_RANK} FROM sep) AS t WHERE rank <= 5) AS u
GROUP BY feature""")
    S["cluster_size_summary"] = with_(SEG, f"""
SELECT cluster, count(*) AS "count", {r('count(*) / sum(count(*)) OVER ()', 4)} AS share,
  {r('100.0 * (count(*) / sum(count(*)) OVER ())', 2)} AS percent
FROM seg GROUP BY cluster""")
    S["numeric_profile"] = round_cols(with_(SEG + PROFILE[:1], """
SELECT cluster, feature, avg(value) AS mean, quantile_cont(value, 0.5) AS median FROM wlong GROUP BY cluster, feature"""),
        ["mean", "median"])
    S["numeric_mean_profile"] = round_cols(with_(SEG + PROFILE[:1], """
SELECT cluster, feature, avg(value) AS cluster_mean FROM wlong GROUP BY cluster, feature"""), ["cluster_mean"])
    S["relative_profile"] = round_cols(with_(SEG + PROFILE[:2], """
SELECT cluster, feature, relative_to_portfolio FROM wprof"""), ["relative_to_portfolio"])
    S["profile_long"] = round_cols(with_(SEG + PROFILE[:2], "SELECT * FROM wprof"), PROFILE_DOUBLES)
    cats = _union([f"SELECT cluster, '{c}' AS feature, CAST(\"{c}\" AS VARCHAR) AS value FROM seg"
                   for c in SEG_CATEGORICAL])
    S["categorical_profile"] = round_cols(with_(SEG, f"""
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY feature, cluster ORDER BY share DESC, value ASC NULLS FIRST) AS INTEGER) AS rank
  FROM (
    SELECT feature, cluster, value, "count", cluster_total, "count" / cluster_total AS share, portfolio_count,
      portfolio_count / portfolio_total AS portfolio_share,
      ("count" / cluster_total) / (portfolio_count / portfolio_total) AS lift
    FROM (
      SELECT feature, cluster, value, "count",
        CAST(sum("count") OVER (PARTITION BY feature, cluster) AS BIGINT) AS cluster_total,
        CAST(sum("count") OVER (PARTITION BY feature, value) AS BIGINT) AS portfolio_count,
        sum("count") OVER (PARTITION BY feature) AS portfolio_total
      FROM (SELECT feature, cluster, value, count(*) AS "count" FROM ({cats}) AS l GROUP BY ALL) AS g) AS h) AS i) AS j
WHERE rank <= 5"""), ["share", "portfolio_share", "lift"])
    S["top_distinguishing"] = round_cols(with_(SEG + PROFILE, "SELECT * FROM wdist"),
                                         PROFILE_DOUBLES + ["signed_relative_distance_from_portfolio",
                                                            "abs_relative_distance_from_portfolio"])
    S["cluster_feature_notes"] = round_cols(with_(SEG + PROFILE[:2], f"""
SELECT *, {note_case('feature', rules.CLUSTER_NOTE_RULES)} AS business_interpretation FROM wprof"""), PROFILE_DOUBLES)
    S["preliminary_labels"] = with_(SEG + PROFILE + [f"""noted AS (
  SELECT *, {note_case('feature', rules.CLUSTER_NOTE_RULES)} AS business_interpretation FROM wdist)""",
        """tn AS (
  SELECT cluster, list(business_interpretation ORDER BY r) AS top_notes FROM (
    SELECT cluster, business_interpretation,
      row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, business_interpretation) AS r
    FROM noted GROUP BY cluster, business_interpretation) AS t WHERE r <= 3 GROUP BY cluster)""",
        """tf AS (SELECT cluster, list(feature ORDER BY rank) AS top_features FROM noted WHERE rank <= 5 GROUP BY cluster)"""],
        f"""SELECT tn.cluster, top_notes, top_features,
  {segment_label_case('top_notes', rules.SEGMENT_LABEL_RULES)} AS preliminary_cluster_label,
  'Dominant notes: ' || array_to_string(top_notes, ', ') || '. Top distinguishing features: '
    || array_to_string(top_features, ', ') AS label_rationale
FROM tn JOIN tf ON tn.cluster = tf.cluster""")
    S["manual_labels"] = with_(SEG, f"""
SELECT cluster, "count", share, percent,
  CASE cluster WHEN 0 THEN 'Thin or excluded bureau file' WHEN 1 THEN 'Subprime borrowers'
       ELSE 'Unlabeled cluster' END AS cluster_label
FROM (SELECT cluster, count(*) AS "count", {r('count(*) / sum(count(*)) OVER ()', 4)} AS share,
        {r('100.0 * (count(*) / sum(count(*)) OVER ())', 2)} AS percent FROM seg GROUP BY cluster) AS t""")
    S["cluster_profile_rounded"] = with_(SEG + PROFILE[:2], f"""
SELECT cluster, feature, {r('cluster_mean', 3)} AS cluster_mean,
  {r(f"{r('cluster_mean', 3)} / nullif(portfolio_mean, 0)", 2)} AS relative_to_portfolio FROM wprof""")
    S["cluster_sizes_top_models"] = with_(SEG, f"""
SELECT model, cluster, "count", {r('"count" / sum("count") OVER (PARTITION BY model)', 4)} AS share FROM (
  SELECT 'cluster' AS model, cluster, count(*) AS "count" FROM seg GROUP BY cluster
  UNION ALL
  SELECT 'cluster_ltv', cluster_ltv, count(*) FROM seg GROUP BY cluster_ltv) AS t""")
    return S
