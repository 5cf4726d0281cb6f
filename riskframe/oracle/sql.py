"""DuckDB SQL for every registered query (see ``oracle_queries``)."""

from __future__ import annotations


# ----------------------------------------------------------------- helpers
def r(x: str, d: int = 6) -> str:
    """Half-up rounding, the same formula as ``functions.numeric.round_to``."""
    return f"(floor(({x}) * 1e{d} + 0.5) / 1e{d})"


def sd(num: str, den: str, min_den: float | int = 0) -> str:
    return (f"(CASE WHEN ({den}) IS NOT NULL AND abs({den}) > {min_den} "
            f"THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END)")


def round_cols(sql: str, cols: list[str]) -> str:
    if not cols:
        return sql
    rep = ", ".join(f"{r(c)} AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS _q"


def with_(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def qcol(c: str) -> str:
    return f'"{c}"'


# ----------------------------------------------------------------- fixtures
LOAN_BOOK = [
    """li AS (
  SELECT l_orderkey,
    avg(l_discount) AS avg_discount,
    sum(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END) AS net_price,
    count(*) AS n_lines,
    CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS n_open,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS n_returned,
    CAST(sum(CASE WHEN l_shipdate >= TIMESTAMP '2000-01-01' THEN 1 ELSE 0 END) AS BIGINT) AS n_recent,
    CAST(sum(CASE WHEN l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '2000-01-01' THEN 1 ELSE 0 END) AS BIGINT)
      AS n_returned_recent,
    CAST(sum(CASE WHEN l_discount >= CAST(0.085 AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS n_high_discount,
    sum(l_quantity) AS sum_quantity
  FROM lineitem GROUP BY l_orderkey)""",
    """book AS (
  SELECT o_orderkey AS unique_id,
    CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS INTEGER) AS disbursal_date,
    CAST(NULL AS VARCHAR) AS state_id,
    1 AS employee_code_id,
    1 AS mobile_avl_flag,
    c_custkey % 2 AS voter_id_flag,
    o_totalprice * CAST(1.02 AS DOUBLE) AS sanctioned_amount,
    o_totalprice AS disbursed_amount,
    o_totalprice / (12 + o_orderkey % 48) AS instalment_amount,
    coalesce(floor(net_price * 100 + 0.5) / 100.0, 0.0) AS current_balance_amount,
    60.0 + 450.0 * floor(avg_discount * 10000 + 0.5) / 10000.0 AS loan_to_value,
    CAST(floor(300 + c_acctbal / 18) AS BIGINT) AS fico_score,
    CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL
         WHEN c_mktsegment = 'AUTOMOBILE' THEN 'Salaried'
         WHEN c_mktsegment = 'BUILDING' THEN 'Self employed'
         WHEN c_mktsegment = 'FURNITURE' THEN 'Missing'
         ELSE ' ' END AS employment_type,
    n_name AS state,
    c_custkey % 82 AS branch_id,
    21 + c_custkey % 45 AS age,
    coalesce(n_lines, 0) AS number_of_accounts,
    coalesce(n_open, 0) AS number_of_active_accounts,
    coalesce(n_returned, 0) AS number_of_overdue_accounts,
    coalesce(n_recent, 0) AS number_of_accounts_opened_last_6_months,
    coalesce(n_returned_recent, 0) AS number_of_delinquencies_last_6_months,
    coalesce(CAST(floor(sum_quantity / 4) AS BIGINT), 0) AS average_account_age,
    coalesce(n_high_discount, 0) AS number_of_inquiries,
    CASE WHEN (coalesce(n_returned, 0) >= 2 AND c_acctbal < 2000) OR o_orderkey % 20 = 0
         THEN 1 ELSE 0 END AS target
  FROM orders
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN li ON o_orderkey = l_orderkey)""",
    """loan_book AS (
  SELECT * FROM book UNION ALL SELECT * FROM book WHERE unique_id % 997 = 0)""",
    """loans_labelled AS (SELECT * EXCLUDE (number_of_delinquencies_last_6_months) FROM loan_book)""",
    """loans_unlabelled AS (SELECT * EXCLUDE (target) FROM loan_book)""",
]

RAW_TYPES = {
    "unique_id": "bigint", "disbursal_date": "int", "state_id": "string",
    "employee_code_id": "int", "mobile_avl_flag": "int", "voter_id_flag": "bigint",
    "sanctioned_amount": "double", "disbursed_amount": "double", "instalment_amount": "double",
    "current_balance_amount": "double", "loan_to_value": "double", "fico_score": "bigint",
    "employment_type": "string", "state": "string", "branch_id": "bigint", "age": "bigint",
    "number_of_accounts": "bigint", "number_of_active_accounts": "bigint",
    "number_of_overdue_accounts": "bigint", "number_of_accounts_opened_last_6_months": "bigint",
    "number_of_delinquencies_last_6_months": "bigint", "average_account_age": "bigint",
    "number_of_inquiries": "bigint", "target": "int",
}
RAW_LABELLED = [c for c in RAW_TYPES if c != "number_of_delinquencies_last_6_months"]
RAW_UNLABELLED = [c for c in RAW_TYPES if c != "target"]


def clean_ctes(src: str, name: str = "cleaned") -> list[str]:
    """C6 in SQL: rename + serial date + missing tokens, distinct rows, drop columns."""
    return [
        f"""{name}_dedup AS (
  SELECT DISTINCT * EXCLUDE (disbursal_date, employment_type),
    DATE '1899-12-30' + CAST(disbursal_date AS INTEGER) AS disbursement_date,
    CASE WHEN employment_type IS NULL OR employment_type IN ('Missing', 'missing', '', ' ')
         THEN 'Unknown' ELSE employment_type END AS employment_type
  FROM {src})""",
        f"""{name} AS (
  SELECT * EXCLUDE (state_id, employee_code_id, mobile_avl_flag, unique_id, voter_id_flag, sanctioned_amount)
  FROM {name}_dedup)""",
    ]


def _fico_rating(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL THEN 'Unknown' WHEN {c} < 300 THEN 'Bureau Excluded' "
            f"WHEN {c} < 580 THEN 'Poor' WHEN {c} < 670 THEN 'Fair' WHEN {c} < 740 THEN 'Good' "
            f"WHEN {c} < 800 THEN 'Very Good' ELSE 'Exceptional' END")


def _fico_ordinal(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} < 300 THEN 0 WHEN {c} < 580 THEN 1 "
            f"WHEN {c} < 670 THEN 2 WHEN {c} < 740 THEN 3 WHEN {c} < 800 THEN 4 ELSE 5 END")


POS_BAL = "(CASE WHEN current_balance_amount >= 0 THEN CAST(current_balance_amount AS DOUBLE) ELSE 0.0 END)"


def feature_ctes(src: str, name: str = "feats", unlabelled: bool = False) -> list[str]:
    """F20 in SQL on the raw view ``src``."""
    delinquency = (f",\n    {sd('number_of_delinquencies_last_6_months', 'number_of_accounts')}"
                   " AS recent_delinquency_account_ratio") if unlabelled else ""
    return clean_ctes(src, f"{name}_clean") + [
        f"""{name} AS (
  SELECT * EXCLUDE (disbursement_date),
    CAST(year(disbursement_date) AS INTEGER) AS disbursement_year,
    CAST(quarter(disbursement_date) AS INTEGER) AS disbursement_quarter,
    CAST(month(disbursement_date) AS INTEGER) AS disbursement_month,
    CAST(date_diff('day', (SELECT min(disbursement_date) FROM {name}_clean), disbursement_date) AS INTEGER)
      AS days_since_disbursement,
    CASE WHEN fico_score < 300 THEN 1 ELSE 0 END AS is_bureau_excluded,
    CASE WHEN fico_score >= 300 THEN CAST(fico_score AS DOUBLE) END AS legit_fico_score,
    {_fico_rating('fico_score')} AS fico_rating,
    {_fico_ordinal('fico_score')} AS fico_rating_ordinal,
    CASE WHEN current_balance_amount < 0 THEN 1 ELSE 0 END AS has_negative_current_balance,
    CASE WHEN current_balance_amount = 0 THEN 1 ELSE 0 END AS has_zero_current_balance,
    {POS_BAL} AS current_balance_positive_amount,
    {sd('instalment_amount', 'disbursed_amount', 1000)} AS instalment_to_disbursed_ratio,
    {sd(POS_BAL, 'disbursed_amount')} AS balance_to_disbursed_ratio,
    CASE WHEN number_of_active_accounts = 0 THEN 1 ELSE 0 END AS has_no_active_accounts,
    {sd('number_of_active_accounts', 'number_of_accounts')} AS active_account_ratio,
    {sd('number_of_overdue_accounts', 'number_of_accounts')} AS overdue_account_ratio,
    {sd('number_of_accounts_opened_last_6_months', 'number_of_accounts')} AS recently_opened_account_ratio{delinquency},
    CASE WHEN average_account_age <= 5 THEN 'Very Young' WHEN average_account_age <= 11 THEN 'Young'
         WHEN average_account_age <= 35 THEN 'Established' WHEN average_account_age <= 59 THEN 'Mature'
         WHEN average_account_age IS NOT NULL THEN 'Seasoned' END AS credit_history_age_band,
    {sd('number_of_accounts', 'average_account_age')} AS accounts_per_history_month,
    {sd('number_of_accounts_opened_last_6_months', 'average_account_age')} AS recently_opened_per_history_month,
    CASE WHEN number_of_inquiries <= 0 THEN 'No Inquiry' WHEN number_of_inquiries <= 1 THEN 'Single Inquiry'
         WHEN number_of_inquiries <= 3 THEN 'Moderate Inquiries'
         WHEN number_of_inquiries IS NOT NULL THEN 'High Inquiries' END AS inquiry_intensity_band,
    {sd('number_of_inquiries', 'average_account_age')} AS inquiry_per_history_month,
    {sd('number_of_inquiries', 'number_of_accounts')} AS inquiry_to_account_ratio,
    CASE WHEN loan_to_value >= 80 THEN 1 ELSE 0 END AS is_high_ltv,
    CASE WHEN loan_to_value >= 90 THEN 1 ELSE 0 END AS is_very_high_ltv,
    CASE WHEN loan_to_value <= 100 THEN CAST(loan_to_value AS DOUBLE) END AS legit_ltv
  FROM {name}_clean)""",
    ]


# column order = the Spark plan's output order
FEATURE_TYPES = {
    "disbursed_amount": "double",
    "instalment_amount": "double",
    "current_balance_amount": "double",
    "loan_to_value": "double",
    "fico_score": "bigint",
    "employment_type": "string",
    "state": "string",
    "branch_id": "bigint",
    "age": "bigint",
    "number_of_accounts": "bigint",
    "number_of_active_accounts": "bigint",
    "number_of_overdue_accounts": "bigint",
    "number_of_accounts_opened_last_6_months": "bigint",
    "average_account_age": "bigint",
    "number_of_inquiries": "bigint",
    "target": "int",
    "disbursement_year": "int",
    "disbursement_quarter": "int",
    "disbursement_month": "int",
    "days_since_disbursement": "int",
    "is_bureau_excluded": "int",
    "legit_fico_score": "double",
    "fico_rating": "string",
    "fico_rating_ordinal": "int",
    "has_negative_current_balance": "int",
    "has_zero_current_balance": "int",
    "current_balance_positive_amount": "double",
    "instalment_to_disbursed_ratio": "double",
    "balance_to_disbursed_ratio": "double",
    "has_no_active_accounts": "int",
    "active_account_ratio": "double",
    "overdue_account_ratio": "double",
    "recently_opened_account_ratio": "double",
    "credit_history_age_band": "string",
    "accounts_per_history_month": "double",
    "recently_opened_per_history_month": "double",
    "inquiry_intensity_band": "string",
    "inquiry_per_history_month": "double",
    "inquiry_to_account_ratio": "double",
    "is_high_ltv": "int",
    "is_very_high_ltv": "int",
    "legit_ltv": "double",
}
FEATURE_COLS = list(FEATURE_TYPES)
FEATURE_DOUBLES = [c for c, t in FEATURE_TYPES.items() if t == "double"]
FEATURE_NUMERIC = [c for c, t in FEATURE_TYPES.items() if t != "string"]
FEATURE_STRINGS = [c for c, t in FEATURE_TYPES.items() if t == "string"]

# column order = the Spark plan's output order
UNLABELLED_FEATURE_TYPES = {
    "disbursed_amount": "double",
    "instalment_amount": "double",
    "current_balance_amount": "double",
    "loan_to_value": "double",
    "fico_score": "bigint",
    "employment_type": "string",
    "state": "string",
    "branch_id": "bigint",
    "age": "bigint",
    "number_of_accounts": "bigint",
    "number_of_active_accounts": "bigint",
    "number_of_overdue_accounts": "bigint",
    "number_of_accounts_opened_last_6_months": "bigint",
    "number_of_delinquencies_last_6_months": "bigint",
    "average_account_age": "bigint",
    "number_of_inquiries": "bigint",
    "disbursement_year": "int",
    "disbursement_quarter": "int",
    "disbursement_month": "int",
    "days_since_disbursement": "int",
    "is_bureau_excluded": "int",
    "legit_fico_score": "double",
    "fico_rating": "string",
    "fico_rating_ordinal": "int",
    "has_negative_current_balance": "int",
    "has_zero_current_balance": "int",
    "current_balance_positive_amount": "double",
    "instalment_to_disbursed_ratio": "double",
    "balance_to_disbursed_ratio": "double",
    "has_no_active_accounts": "int",
    "active_account_ratio": "double",
    "overdue_account_ratio": "double",
    "recently_opened_account_ratio": "double",
    "recent_delinquency_account_ratio": "double",
    "credit_history_age_band": "string",
    "accounts_per_history_month": "double",
    "recently_opened_per_history_month": "double",
    "inquiry_intensity_band": "string",
    "inquiry_per_history_month": "double",
    "inquiry_to_account_ratio": "double",
    "is_high_ltv": "int",
    "is_very_high_ltv": "int",
    "legit_ltv": "double",
}

BASE = LOAN_BOOK + feature_ctes("loans_labelled")
