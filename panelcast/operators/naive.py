"""Closed-form forecasts over the rows of ``split_series``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERIOD = 12


def _steps(horizon: int, step) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), step)


def _back(k: Column | int) -> Column:
    """k-th value from the end of the history; 1 is the last."""
    return F.get("y", (F.size("y") - k).cast("int"))


def forecasts(horizon: int = 12) -> dict[str, Column]:
    """Forecast array of each closed-form model, from the column ``y``."""
    change = _back(1) - _back(1 + PERIOD)
    return {
        # Each month repeats the value one year before.
        "seasonal_naive": _steps(horizon, lambda i: _back(F.lit(PERIOD) - i % PERIOD)),
        # Each month repeats the last known value.
        "random_walk": _steps(horizon, lambda i: _back(1)),
        # Last year's month plus the change of the last known month over its year, per year ahead.
        "seasonal_random_walk": _steps(
            horizon,
            lambda i: _back(F.lit(PERIOD) - i % PERIOD) + change * (F.floor(i / PERIOD) + 1),
        ),
    }


def _with(series: DataFrame, model: str, horizon: int) -> DataFrame:
    return series.withColumns({"pred": forecasts(horizon)[model], "model": F.lit(model)})


def seasonal_naive(series: DataFrame, horizon: int = 12) -> DataFrame:
    return _with(series, "seasonal_naive", horizon)


def random_walk(series: DataFrame, horizon: int = 12) -> DataFrame:
    return _with(series, "random_walk", horizon)


def seasonal_random_walk(series: DataFrame, horizon: int = 12) -> DataFrame:
    return _with(series, "seasonal_random_walk", horizon)
