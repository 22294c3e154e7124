"""Column expressions shared by the operators: months, weights, names, cleaning."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# The month layouts that may be read, as Spark patterns and their strptime twins.
# Anything else is missing or an error, never a guess.
MONTH_FORMATS = {"yyyy-MM": "%Y-%m", "yyyy-'M'MM": "%Y-M%m", "yyyy-MM-dd": "%Y-%m-%d"}


def as_date(value: str | date | int) -> date:
    """A date from an ISO string, a date, or a year (its first day)."""
    if isinstance(value, int):
        return date(value, 1, 1)
    return value if isinstance(value, date) else date.fromisoformat(value)


def add_months(day: date, months: int) -> date:
    """``day`` (first of a month) moved by whole months."""
    index = day.year * 12 + day.month - 1 + months
    return date(index // 12, index % 12 + 1, 1)


def parse_month(column: Column | str, formats: Sequence[str] = tuple(MONTH_FORMATS)) -> Column:
    """First day of the month of a label, tried against an explicit list of formats."""
    label = F.col(column) if isinstance(column, str) else column
    days = [F.try_to_timestamp(label, F.lit(f)).cast("date") for f in formats]
    return F.trunc(F.coalesce(*days), "month")


def null_if_nan(column: Column | str) -> Column:
    """NaN to NULL: the engine knows one missing marker only."""
    value = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(value), value)


def triangular_weights(window: int) -> list[float]:
    """Weights of a symmetric triangular window, normalised to sum to one."""
    peak = (window + 1) / 2
    raw = [peak - abs(i + 1 - peak) for i in range(window)]
    return [w / sum(raw) for w in raw]


def alpha_tag(alpha: float) -> str:
    """0.9 -> '09', as used in feature column names."""
    return str(alpha).replace(".", "")


def clean_name(name: str) -> str:
    """Keep ASCII letters, digits and underscores only."""
    return re.sub(r"[^A-Za-z0-9_]+", "", name)
