"""Rule tables and the Column expressions built from them.

Fixed values: these must equal the reference's results (labels, cut points,
tokens, note texts), so they are kept here as plain data, in their natural
order.  Column names are our snake_case versions of the reference names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col_

# ---------------------------------------------------------------- fixed values
# Cleaning (C1, C3, C5)
RENAME_MAP = {"disbursal_date": "disbursement_date"}
MISSING_TOKENS = {"employment_type": ["Missing", "missing", "", " "]}
MISSING_FILL = "Unknown"
NONINFORMATIVE_COLUMNS = ["state_id", "employee_code_id", "mobile_avl_flag",
                          "unique_id", "voter_id_flag", "sanctioned_amount"]
DATE_COLUMNS = ["disbursement_date"]
SERIAL_DAY_EPOCH = "1899-12-30"

# FICO rating (F6, F7): exclusive upper bound -> label; the last has none
FICO_BANDS = [(300, "Bureau Excluded"), (580, "Poor"), (670, "Fair"),
              (740, "Good"), (800, "Very Good"), (None, "Exceptional")]
FICO_UNKNOWN = "Unknown"
FICO_ORDINAL = {"Bureau Excluded": 0, "Poor": 1, "Fair": 2, "Good": 3,
                "Very Good": 4, "Exceptional": 5}
BUREAU_EXCLUDED_BELOW = 300

# Right-closed bands (F13, F15): inclusive upper bound -> label
CREDIT_HISTORY_BANDS = [(5, "Very Young"), (11, "Young"), (35, "Established"),
                        (59, "Mature"), (None, "Seasoned")]
INQUIRY_BANDS = [(0, "No Inquiry"), (1, "Single Inquiry"), (3, "Moderate Inquiries"),
                 (None, "High Inquiries")]

# LTV (F17)
HIGH_LTV, VERY_HIGH_LTV, MAX_LEGIT_LTV = 80, 90, 100
INSTALMENT_MIN_DISBURSED = 1000

# Model roles (L2): substring of the model name -> role
MODEL_ROLES = [("logistic_regression", "Explainable baseline"),
               ("decision_tree", "Interpretable non-linear benchmark"),
               ("random_forest", "Tree ensemble benchmark"),
               ("gradient_boosting", "Boosting benchmark")]
MODEL_ROLE_DEFAULT = "Candidate model"

# Feature notes for classifiers (I8): any key contained in the normalised
# feature name (lower case, "_" read as " ") -> note; first rule wins
MODEL_NOTE_RULES = [
    (["fico"], "Credit bureau quality / creditworthiness signal"),
    (["bureau excluded"], "Customer may have insufficient or excluded bureau history"),
    (["loan to value"], "Loan exposure relative to asset value"),
    (["overdue"], "Historical repayment stress / delinquency signal"),
    (["delinquency"], "Recent repayment stress signal"),
    (["inquiries"], "Recent credit-seeking behavior"),
    (["balance"], "Outstanding balance / leverage signal"),
    (["disbursed"], "Exposure size signal"),
    (["instalment", "installment"], "Repayment burden signal"),
    (["active account"], "Current credit activity signal"),
    (["state"], "Geographic / portfolio mix signal"),
    (["employment"], "Income stability / employment profile signal"),
    (["age"], "Customer maturity / lifecycle signal"),
]
# Feature notes for cluster profiles
CLUSTER_NOTE_RULES = [
    (["fico"], "Credit bureau quality / creditworthiness signal"),
    (["bureau excluded"], "Customer may have insufficient or excluded bureau history"),
    (["loan to value", "ltv"], "Loan exposure relative to asset value"),
    (["overdue"], "Historical repayment stress"),
    (["delinquency"], "Recent repayment stress signal"),
    (["inquir"], "Recent credit seeking behavior"),
    (["balance"], "Outstanding balance / leverage signal"),
    (["disbursed"], "Exposure size signal"),
    (["instalment", "installment"], "Repayment burden signal"),
    (["active account"], "Current credit activity signal"),
    (["number of accounts", "accounts per"], "Credit history depth"),
    (["recently opened", "opened last 6 months"], "Recent credit activity signal"),
    (["age"], "Customer maturity / lifecycle signal"),
    (["state"], "Geographic / portfolio mix signal"),
    (["employment"], "Income stability / employment profile signal"),
]
NOTE_DEFAULT = "Requires manual business review"
# Segment labels (W10): any key contained in any note (lower case) -> label
SEGMENT_LABEL_RULES = [
    (["repayment stress"], "Repayment stress / delinquency segment"),
    (["credit bureau quality"], "Credit bureau quality segment"),
    (["loan exposure"], "High collateral / LTV-driven segment"),
    (["exposure size", "outstanding balance"], "High exposure / balance-driven segment"),
    (["recent credit seeking", "recent credit activity"], "Recent credit activity segment"),
    (["credit history depth"], "Credit history depth segment"),
    (["credit maturity"], "Customer lifecycle segment"),
]
SEGMENT_LABEL_DEFAULT = "General portfolio segment"
UNLABELED_CLUSTER = "Unlabeled cluster"

# Feature-group prefixes written by the assembler (M7) and stripped by I1
GROUP_PREFIXES = ["numeric", "low_cardinality_categorical", "high_cardinality_categorical"]
FORCED_HIGH_CARDINALITY = ["state"]
# ------------------------------------------------------------ end fixed values


def band_left_open(c, bands, null_label=None) -> Column:
    """Label by exclusive upper bounds (``x < bound``); null -> ``null_label``."""
    c = col_(c)
    expr = F.when(c.isNull(), F.lit(null_label))
    for bound, label in bands:
        expr = expr.when(c < F.lit(bound), F.lit(label)) if bound is not None \
            else expr.otherwise(F.lit(label))
    return expr


def band_right_closed(c, bands) -> Column:
    """pandas-``cut`` style right-closed bins (-inf, b1], (b1, b2], ...; null stays null."""
    c = col_(c)
    expr = None
    for bound, label in bands:
        if bound is None:
            return expr.when(c.isNotNull(), F.lit(label))
        cond = c <= F.lit(bound)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def normalised_name(c) -> Column:
    return F.regexp_replace(F.lower(col_(c)), "_", " ")


def first_contains_rule(text: Column, rules, default: str) -> Column:
    """First rule whose key occurs in ``text`` gives the value; else ``default``."""
    expr = None
    for keys, value in rules:
        cond = reduce(lambda a, b: a | b, [text.contains(k) for k in keys])
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr.otherwise(F.lit(default))


def model_role(model_col) -> Column:
    return first_contains_rule(col_(model_col),
                               [([k], v) for k, v in MODEL_ROLES], MODEL_ROLE_DEFAULT)


def model_feature_note(feature_col) -> Column:
    return first_contains_rule(normalised_name(feature_col), MODEL_NOTE_RULES, NOTE_DEFAULT)


def cluster_feature_note(feature_col) -> Column:
    return first_contains_rule(normalised_name(feature_col), CLUSTER_NOTE_RULES, NOTE_DEFAULT)


def segment_label(notes_array_col) -> Column:
    """First rule with a key contained in any of the notes (W10, substring match)."""
    notes = F.transform(col_(notes_array_col), lambda n: F.lower(n))

    def has(key):
        return F.exists(notes, lambda n: n.contains(key))

    expr = None
    for keys, value in SEGMENT_LABEL_RULES:
        cond = reduce(lambda a, b: a | b, [has(k) for k in keys])
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr.otherwise(F.lit(SEGMENT_LABEL_DEFAULT))


def strip_group_prefix(c) -> Column:
    """Remove one leading ``<group>__`` prefix written by the assembler."""
    pattern = "^(" + "|".join(GROUP_PREFIXES) + ")__"
    return F.regexp_replace(col_(c), pattern, "")
