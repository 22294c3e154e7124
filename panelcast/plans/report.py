"""Scored forecasts and their rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.metrics import mae, smape

FORECAST_KEYS = ("Country", "Product", "Time")

# The columns of the wide scored table, in its order.
MODELS = ("lgbm", "rf", "mlp", "gbm", "xgb", "catb", "tes", "sarima")

# Steps ahead a model forecasts: regressors see the true previous month, the others do not.
HORIZONS = {"lgbm": 1, "rf": 1, "mlp": 1, "gbm": 1, "xgb": 1, "catb": 1}


def score(forecasts: DataFrame) -> DataFrame:
    """Add the row error to ``forecast(Country, Product, Time, model, pred, real)``."""
    return forecasts.withColumn("smape", smape("pred", "real"))


def attach_actuals(predictions: DataFrame, panel: DataFrame) -> DataFrame:
    """Pair predictions with the real values by key. Predictions without one keep a NULL."""
    real = panel.select(*FORECAST_KEYS, F.col("Import").alias("real"))
    return predictions.join(real, list(FORECAST_KEYS), "left")


def rank_by(
    scored: DataFrame, keys: Sequence[str] = ("Product",), sort_first: Sequence[str] = ()
) -> DataFrame:
    """Mean error per group, best first, groups without any error last."""
    means = scored.groupBy(*keys).agg(F.avg("smape").alias("mean_smape"))
    return means.orderBy(*sort_first, F.asc_nulls_last("mean_smape"), *keys)


def rank_products(scored: DataFrame) -> DataFrame:
    """Every product ranking at once: one aggregation over all years and models."""
    keys = ("year", "model", "Product")
    rows = scored.withColumn("year", F.year("Time"))
    return rank_by(rows, keys, sort_first=("year", "model"))


def error_by(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean absolute error per group."""
    return scored.groupBy(*keys).agg(mae("pred", "real").alias("mae"))


def coverage(scored: DataFrame) -> DataFrame:
    """Distinct countries per product."""
    return scored.groupBy("Product").agg(F.countDistinct("Country").alias("countries"))


def leaderboard(
    scored: DataFrame,
    levels: Sequence[Sequence[str]] = ((), ("Product",), ("Country", "Product")),
) -> DataFrame:
    """Mean error of each model at several levels in one aggregation; NULL keys mean "all"."""
    columns = [F.col("model"), F.col("Country"), F.col("Product")]
    sets = [[F.col("model"), *[F.col(c) for c in level]] for level in levels]
    means = scored.groupingSets(sets, *columns).agg(
        F.avg("smape").alias("mean_smape"), F.count("smape").alias("n")
    )
    horizon = F.coalesce(
        F.try_element_at(
            F.create_map(*[F.lit(x) for pair in HORIZONS.items() for x in pair]), F.col("model")
        ),
        F.lit(12),
    )
    return means.withColumn("horizon", horizon)


def parameter_frequency(best: DataFrame, params: Sequence[str]) -> DataFrame:
    """How often each parameter combination won, and of how many wins in all.

    The frequencies are one row per combination of a fixed grid, so their total is a small window.
    """
    wins = best.groupBy(*params).agg(F.count("*").alias("wins"))
    return wins.withColumn("total", F.sum("wins").over(Window.partitionBy(F.lit(0))))


def scored_wide(scored: DataFrame, models: Sequence[str] = MODELS) -> DataFrame:
    """One row per series, cutoff and month: real value, then each model's prediction and error.

    Models are matched by key in one aggregation, in place of a chain of joins. Forecasts without a
    cutoff have one row per month.
    """
    cells = [F.max("real").alias("Import")]
    for m in models:
        mine = F.col("model") == m
        cells.append(F.max(F.when(mine, F.col("pred"))).alias(m))
        cells.append(F.max(F.when(mine, F.col("smape"))).alias(f"{m.upper()}_smape"))
    keys = [*FORECAST_KEYS, *(["cutoff"] if "cutoff" in scored.columns else [])]
    return scored.groupBy(*keys).agg(*cells)


def model_rows(scored: DataFrame, models: Sequence[str] = MODELS) -> DataFrame:
    """Forecast rows of each model, and how many the fullest model has more: a model that lost rows
    shows as NULL cells only in the wide table."""
    counted = scored.agg(*[F.count_if(F.col("model") == m).alias(m) for m in models])
    most = F.greatest(*[F.col(m) for m in models], F.lit(0))
    rows = [
        F.struct(F.lit(m).alias("model"), F.col(m).alias("n"), (most - F.col(m)).alias("missing"))
        for m in models
    ]
    return counted.select(F.inline(F.array(*rows)))
