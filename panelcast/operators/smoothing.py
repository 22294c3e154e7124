"""Additive Holt-Winters: fixed parameters, grid search, refit.

For fixed (alpha, beta, gamma) every state of the recursion is linear in the history, and so are
both ways to choose the initial states. A forecast is therefore ``weights @ y``, with weights that
depend only on the parameters and the length of the series. The grid search computes the weights of
all parameter sets once per length in each Python worker and then scores whole Arrow batches of
series with one matrix product, where a fold would walk every series once per parameter set.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.session import ship_package

PERIOD = 12

# The smoothing levels tried for alpha, beta and gamma each.
LEVELS = (0.1, 0.3, 0.5, 0.7, 0.9)
GRID = tuple(product(LEVELS, LEVELS, LEVELS))

# Digits to which errors are compared, so that ties go to the first parameter set.
MAE_DIGITS = 6

BEST = (
    "alpha double, beta double, gamma double, mae double, pred array<double>, "
    "n_failed int, status string"
)


def grid_column(grid: Sequence[tuple[float, float, float]] = GRID) -> Column:
    """The parameter sets as one array column: exploding it pairs every row with every set."""
    names = ("alpha", "beta", "gamma")
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, s)]) for s in grid])


def fold(
    y: Column, alpha: Column, beta: Column, gamma: Column, horizon: int = 12, period: int = PERIOD
) -> Column:
    """Forecast array of one parameter set with first-year initial states, as a fold in the JVM."""
    first = F.slice(y, 1, period)

    def mean(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v) / period

    level = mean(first)
    trend = (mean(F.slice(y, period + 1, period)) - level) / period
    start = F.struct(
        level.alias("l"), trend.alias("b"), F.transform(first, lambda v: v - level).alias("s")
    )

    def step(state: Column, v: Column) -> Column:
        base = state["l"] + state["b"]
        season = state["s"][0]
        new_level = alpha * (v - season) + (1 - alpha) * base
        new_trend = beta * (new_level - state["l"]) + (1 - beta) * state["b"]
        new_season = gamma * (v - base) + (1 - gamma) * season
        rest = F.slice(state["s"], 2, period - 1)
        return F.struct(
            new_level.alias("l"),
            new_trend.alias("b"),
            F.concat(rest, F.array(new_season)).alias("s"),
        )

    def unfold(state: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(horizon - 1)),
            lambda i: state["l"] + (i + 1) * state["b"] + F.get(state["s"], i % period),
        )

    return F.aggregate(y, start, step, unfold)


@lru_cache(maxsize=64)
def forecast_weights(
    n: int,
    params: tuple[tuple[float, float, float], ...],
    init: str,
    horizon: int = 12,
    period: int = PERIOD,
) -> np.ndarray:
    """Weights (len(params), horizon, n) with forecast = weights @ y.

    The recursion runs on coefficient rows over (y_1..y_n, level_0, trend_0, season_0 x period).
    """
    alpha, beta, gamma = np.array(params, dtype=float).T[:, :, None]
    width = n + 2 + period
    unit = np.broadcast_to(np.eye(width)[:, None, :], (width, len(params), width))
    level, trend, season = unit[n], unit[n + 1], list(unit[n + 2 :])
    errors = np.empty((len(params), n, width))
    for t in range(n):
        base, oldest = level + trend, season.pop(0)
        errors[:, t] = unit[t] - base - oldest
        new_level = alpha * (unit[t] - oldest) + (1 - alpha) * base
        trend = beta * (new_level - level) + (1 - beta) * trend
        season.append(gamma * (unit[t] - base) + (1 - gamma) * oldest)
        level = new_level
    ahead = np.stack(
        [level + (h + 1) * trend + season[h % period] for h in range(horizon)], axis=1
    )
    if init == "heuristic":
        first, second = np.zeros((2, n))
        first[:period] = second[period : 2 * period] = 1 / period
        states = np.vstack([first, (second - first) / period, np.eye(period, n) - first])
    elif init == "lsq":
        # Initial states with the least squared one-step errors. Moving a constant between level
        # and season changes nothing, hence the pseudo-inverse.
        states = -np.linalg.pinv(errors[:, :, n:], rcond=1e-10) @ errors[:, :, :n]
    else:
        raise ValueError(f"init must be 'heuristic' or 'lsq', not {init!r}")
    return ahead[:, :, :n] + ahead[:, :, n:] @ states


def _batches(y: pd.Series, size: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row positions and stacked histories of series of equal length, in bounded pieces."""
    lengths = y.map(len).to_numpy()
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        for i in range(0, len(rows), size):
            piece = rows[i : i + size]
            yield piece, np.stack([np.asarray(v, dtype=float) for v in y.iloc[piece]])


def _search(grid: tuple, init: str):
    @F.pandas_udf(BEST)
    def best(y: pd.Series, actual: pd.Series) -> pd.DataFrame:
        chosen, mae = np.full((len(y), 3), np.nan), np.full(len(y), np.nan)
        n_failed, status = np.full(len(y), len(grid)), np.full(len(y), "too_short", dtype=object)
        pred = np.full(len(y), None, dtype=object)
        for rows, history in _batches(y):
            if history.shape[1] < 2 * PERIOD:
                continue
            real = np.stack([np.asarray(v, dtype=float) for v in actual.iloc[rows]])
            weights = forecast_weights(history.shape[1], grid, init, real.shape[1])
            ahead = (history @ weights.reshape(-1, history.shape[1]).T).reshape(
                len(rows), len(grid), -1
            )
            errors = np.abs(real[:, None, :] - ahead).mean(axis=2).round(MAE_DIGITS)
            usable = np.isfinite(errors)
            winner = np.where(usable, errors, np.inf).argmin(axis=1)
            fitted = usable.any(axis=1)
            done, k = rows[fitted], winner[fitted]
            n_failed[rows] = (~usable).sum(axis=1)
            status[rows], status[done] = "no_fit", "ok"
            chosen[done], mae[done] = np.array(grid)[k], errors[fitted, k]
            for row, values in zip(done, ahead[fitted, k]):
                pred[row] = values
        return pd.DataFrame(
            {
                "alpha": chosen[:, 0],
                "beta": chosen[:, 1],
                "gamma": chosen[:, 2],
                "mae": mae,
                "pred": pred,
                "n_failed": n_failed.astype("int32"),
                "status": status,
            }
        )

    # A filter on the result must not make the optimizer run the search a second time.
    return best.asNondeterministic()


def _refit(init: str, horizon: int):
    @F.pandas_udf("array<double>")
    def forecast(y: pd.Series, alpha: pd.Series, beta: pd.Series, gamma: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(y), dtype=object)
        params = pd.DataFrame({"a": alpha, "b": beta, "g": gamma}).dropna()
        for chosen, rows in params.groupby(["a", "b", "g"]).groups.items():
            for piece, history in _batches(y.loc[rows]):
                if history.shape[1] < 2 * PERIOD:
                    continue
                weights = forecast_weights(history.shape[1], (chosen,), init, horizon)[0]
                for row, pred in zip(rows[piece], history @ weights.T):
                    out.at[row] = pred.tolist()
        return out

    return forecast


def forecast_holt_winters(
    series: DataFrame,
    alpha: Column | str = "alpha",
    beta: Column | str = "beta",
    gamma: Column | str = "gamma",
    init: str = "lsq",
    horizon: int = 12,
) -> DataFrame:
    """Forecast each row of ``split_series`` with its own parameters."""
    columns = [F.col(c) if isinstance(c, str) else c for c in (alpha, beta, gamma)]
    if init == "heuristic":
        enough = F.size("y") >= 2 * PERIOD
        pred = F.when(enough, fold(F.col("y"), *columns, horizon=horizon))
    else:
        ship_package(series.sparkSession)
        pred = _refit(init, horizon)("y", *columns)
    return series.withColumns({"pred": pred, "model": F.lit("tes")})


def tune_holt_winters(
    series: DataFrame,
    grid: Sequence[tuple[float, float, float]] = GRID,
    init: str = "lsq",
    select_on: str = "holdout",
) -> DataFrame:
    """Best parameters per series by mean absolute error, with the forecast of the winner.

    ``select_on="holdout"`` picks on the forecast year itself; ``"validation"`` picks on the year
    before it and refits, which keeps the test year unseen. A series without a usable fit keeps
    its row, with a status other than ``ok``.
    """
    ship_package(series.sparkSession)
    best = _search(tuple(grid), init)
    if select_on == "holdout":
        tuned = series.withColumn("best", best("y", "actual"))
    elif select_on == "validation":
        size = F.size("y")
        past, recent = F.slice("y", 1, size - PERIOD), F.slice("y", size - PERIOD + 1, PERIOD)
        tuned = series.withColumn("best", best(past, recent))
    else:
        raise ValueError(f"select_on must be 'holdout' or 'validation', not {select_on!r}")
    kept = [c for c in series.columns if c != "status"]
    tuned = tuned.select(*kept, "best.*").withColumn("model", F.lit("tes"))
    return tuned if select_on == "holdout" else forecast_holt_winters(tuned, init=init)
