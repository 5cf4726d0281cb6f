"""Column-expression helpers and rule tables."""

from .numeric import (  # noqa: F401
    categorical_columns, finite_or_null, is_numeric, numeric_columns, q6,
    round_doubles, round_to, safe_divide,
)
from . import rules  # noqa: F401
