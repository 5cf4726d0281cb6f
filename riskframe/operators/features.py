"""Feature projections.

Every feature is a Column expression; the whole build is one lazy
projection on top of the cleaning plan.  The only fitted state is the
reference disbursement date (one global ``min``), learned by
:class:`FeatureEngineer.fit`.  Each block is applied only when its input
columns exist, as in the reference.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules
from ..functions.numeric import safe_divide
from ..session import staged
from .clean import preprocess

DATE_COL = "disbursement_date"
FICO = "fico_score"
BALANCE = "current_balance_amount"
DISBURSED = "disbursed_amount"
INSTALMENT = "instalment_amount"
ACCOUNTS = "number_of_accounts"
ACTIVE = "number_of_active_accounts"
OVERDUE = "number_of_overdue_accounts"
OPENED_6M = "number_of_accounts_opened_last_6_months"
DELINQ_6M = "number_of_delinquencies_last_6_months"
HISTORY = "average_account_age"
INQUIRIES = "number_of_inquiries"
LTV = "loan_to_value"


def _flag(cond: Column) -> Column:
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def date_parts(cols: set[str]) -> dict[str, Column]:
    """year, quarter, month of the disbursement date."""
    if DATE_COL not in cols:
        return {}
    d = F.col(DATE_COL)
    return {"disbursement_year": F.year(d), "disbursement_quarter": F.quarter(d),
            "disbursement_month": F.month(d)}


def days_since_reference(cols: set[str], reference: _dt.date | None) -> dict[str, Column]:
    """days between the date and the learned reference date."""
    if DATE_COL not in cols or reference is None:
        return {}
    return {"days_since_disbursement":
            F.datediff(F.to_date(F.col(DATE_COL)), F.lit(reference.isoformat()).cast("date"))}


def fico_features(cols: set[str]) -> dict[str, Column]:
    """Bureau-excluded flag, legit score, rating and its ordinal."""
    if FICO not in cols:
        return {}
    s = F.col(FICO)
    rating = rules.band_left_open(s, rules.FICO_BANDS, rules.FICO_UNKNOWN)
    ordinal = None
    for label, value in rules.FICO_ORDINAL.items():
        cond = rating == F.lit(label)
        ordinal = F.when(cond, F.lit(value)) if ordinal is None else ordinal.when(cond, F.lit(value))
    return {
        "is_bureau_excluded": _flag(s < rules.BUREAU_EXCLUDED_BELOW),
        "legit_fico_score": F.when(s >= rules.BUREAU_EXCLUDED_BELOW, s.cast("double")),
        "fico_rating": rating,
        "fico_rating_ordinal": ordinal,
    }


def balance_features(cols: set[str]) -> dict[str, Column]:
    """Balance flags, non-negative balance, two exposure ratios."""
    if BALANCE not in cols:
        return {}
    b = F.col(BALANCE)
    positive = F.when(b >= 0, b.cast("double")).otherwise(F.lit(0.0))
    out = {"has_negative_current_balance": _flag(b < 0),
           "has_zero_current_balance": _flag(b == 0),
           "current_balance_positive_amount": positive}
    if {INSTALMENT, DISBURSED} <= cols:
        out["instalment_to_disbursed_ratio"] = safe_divide(
            INSTALMENT, DISBURSED, rules.INSTALMENT_MIN_DISBURSED)
    if DISBURSED in cols:
        out["balance_to_disbursed_ratio"] = safe_divide(positive, DISBURSED)
    return out


def account_activity(cols: set[str]) -> dict[str, Column]:
    """no-active-accounts flag and the active ratio."""
    if ACTIVE not in cols:
        return {}
    out = {"has_no_active_accounts": _flag(F.col(ACTIVE) == 0)}
    if ACCOUNTS in cols:
        out["active_account_ratio"] = safe_divide(ACTIVE, ACCOUNTS)
    return out


def overdue_ratios(cols: set[str]) -> dict[str, Column]:
    """three per-account ratios, each guarded on its own inputs."""
    out = {}
    if ACCOUNTS not in cols:
        return out
    for src, name in ((OVERDUE, "overdue_account_ratio"),
                      (OPENED_6M, "recently_opened_account_ratio"),
                      (DELINQ_6M, "recent_delinquency_account_ratio")):
        if src in cols:
            out[name] = safe_divide(src, ACCOUNTS)
    return out


def credit_history(cols: set[str]) -> dict[str, Column]:
    """right-closed history band and per-history-month ratios."""
    if HISTORY not in cols:
        return {}
    out = {"credit_history_age_band": rules.band_right_closed(HISTORY, rules.CREDIT_HISTORY_BANDS)}
    if ACCOUNTS in cols:
        out["accounts_per_history_month"] = safe_divide(ACCOUNTS, HISTORY)
    if OPENED_6M in cols:
        out["recently_opened_per_history_month"] = safe_divide(OPENED_6M, HISTORY)
    return out


def inquiry_features(cols: set[str]) -> dict[str, Column]:
    """Inquiry band and two inquiry ratios."""
    if INQUIRIES not in cols:
        return {}
    out = {"inquiry_intensity_band": rules.band_right_closed(INQUIRIES, rules.INQUIRY_BANDS)}
    if HISTORY in cols:
        out["inquiry_per_history_month"] = safe_divide(INQUIRIES, HISTORY)
    if ACCOUNTS in cols:
        out["inquiry_to_account_ratio"] = safe_divide(INQUIRIES, ACCOUNTS)
    return out


def ltv_features(cols: set[str]) -> dict[str, Column]:
    """high / very high flags and the legit (<= 100) value."""
    if LTV not in cols:
        return {}
    v = F.col(LTV)
    return {"is_high_ltv": _flag(v >= rules.HIGH_LTV),
            "is_very_high_ltv": _flag(v >= rules.VERY_HIGH_LTV),
            "legit_ltv": F.when(v <= rules.MAX_LEGIT_LTV, v.cast("double"))}


def drop_temporal_columns(df: DataFrame) -> DataFrame:
    """drop every date/timestamp column."""
    temporal = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return df.drop(*[f.name for f in df.schema.fields if isinstance(f.dataType, temporal)])


@dataclass
class FeatureModel:
    """Fitted feature builder: holds the reference disbursement date."""

    reference_date: _dt.date | None

    def transform(self, df: DataFrame) -> DataFrame:
        cols = set(df.columns)
        exprs: dict[str, Column] = {}
        for block in (date_parts(cols), days_since_reference(cols, self.reference_date),
                      fico_features(cols), balance_features(cols), account_activity(cols),
                      overdue_ratios(cols), credit_history(cols), inquiry_features(cols),
                      ltv_features(cols)):
            exprs.update(block)
        # one projection: Catalyst collapses it with the cleaning projections
        return df.withColumns(exprs)


class FeatureEngineer:
    """Estimator for the features; ``fit`` learns min(disbursement date)."""

    def __init__(self, reference_date: _dt.date | None = None):
        self.reference_date = reference_date

    def fit(self, df: DataFrame) -> FeatureModel:
        ref = self.reference_date
        if ref is None and DATE_COL in df.columns:
            # one global min: map-side partial aggregate, a single row returned
            ref = df.agg(F.min(F.to_date(F.col(DATE_COL)))).first()[0]
        return FeatureModel(ref)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


def build_features(df: DataFrame, reference_date: _dt.date | None = None) -> DataFrame:
    """C6 -> fit + transform F2..F17 -> F19 (flagship)."""
    clean = preprocess(df)
    if reference_date is None and DATE_COL in clean.columns:
        clean = staged(clean)  # the reference date is a pass of its own
    return drop_temporal_columns(FeatureEngineer(reference_date).fit_transform(clean))


def build_all_features(datasets: dict[str, DataFrame], save_to: dict[str, str] | None = None
                       ) -> dict[str, DataFrame]:
    """F20 on each dataset (each learns its own reference date); optional save."""
    from ..sources.io import save_features
    out = {}
    for name, df in datasets.items():
        out[name] = build_features(df)
        if save_to and name in save_to:
            save_features(out[name], save_to[name])
    return out
