"""From panel to scored forecasts: several cutoffs and models in one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.expressions import add_months, as_date
from panelcast.operators import arima, learn, mlp, smoothing
from panelcast.operators.panel import KEYS, complete_series, forecast_rows, split_series
from panelcast.plans.report import score
from panelcast.session import shared_path
from panelcast.sources import store

HORIZON = 12


def backtest_series(
    panel: DataFrame,
    start,
    cutoffs: Sequence,
    models: Sequence[str] = ("tes", "sarima"),
    select_on: str = "holdout",
    init: str = "lsq",
    hw_grid: Sequence = smoothing.GRID,
    arima_grid: Sequence = arima.GRID,
) -> DataFrame:
    """Scored forecasts of the per-series models for all cutoffs, from one shuffle of the panel.

    ``panel`` already carries its offset. Series that are incomplete for a cutoff are left out of
    that cutoff only; ``split_series`` reports them.
    """
    series = split_series(panel, start, cutoffs, HORIZON).where("status = 'ok'")
    parts = []
    if "tes" in models:
        parts.append(smoothing.tune_holt_winters(series, hw_grid, init, select_on))
    if "sarima" in models:
        parts.append(arima.tune_arima(series, arima_grid, select_on))
    rows = [forecast_rows(part.where("status = 'ok'")) for part in parts]
    return score(reduce(DataFrame.unionByName, rows))


def _search(vectors: DataFrame, model: str, grid, cutoff, parallelism: int) -> DataFrame:
    if model == "mlp":
        search = mlp.tune_mlp(vectors, grid)
    else:
        search = learn.tune_regressor(vectors, model, grid, parallelism=parallelism)
    return store.best_regressor_params(search, cutoff)


def _forecast(vectors: DataFrame, model: str, settings) -> DataFrame:
    if model == "mlp":
        return mlp.forecast_mlp(vectors, settings)
    return learn.forecast_regressor(vectors, model, settings)


def regressor_frames(
    panel: DataFrame,
    start,
    cutoffs: Sequence,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ("Time",),
) -> DataFrame:
    """The training frames of all cutoffs, with the cutoff as a column.

    Windows within series see the same rows whatever the cutoff, so their features are built once.
    Windows that run on from product to product depend on where the cutoff ends each of them, and
    are built for each cutoff.
    """
    if set(KEYS) <= set(keys):
        return learn.cutoff_frame(panel, start, cutoffs, HORIZON)
    frames = []
    for cutoff in cutoffs:
        complete = complete_series(panel, start, add_months(as_date(cutoff), HORIZON))
        frame = learn.training_frame(complete, cutoff, keys=keys, order=order)
        frames.append(frame.withColumn("cutoff", F.lit(as_date(cutoff))))
    return reduce(DataFrame.unionByName, frames)


def backtest_regressors(
    panel: DataFrame,
    start,
    cutoffs: Sequence,
    models: Sequence[str] = ("lgbm", "rf", "mlp", "gbm", "xgb", "catb"),
    params: Mapping[str, Mapping] | None = None,
    grids: Mapping[str, Mapping] | None = None,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ("Time",),
    saved: str | None = None,
    parallelism: int = learn.PARALLELISM,
) -> DataFrame:
    """Scored one-step forecasts of the regressors. Features are built once for all cutoffs, and up
    to ``parallelism`` models and cutoffs are fitted at the same time.

    A model with an entry in ``grids`` is searched on the folds of the training rows (None: its full
    grid). The winners are saved below ``saved``, read back, and refitted on all training rows. The
    ``lgbm`` profile keeps missing features missing, the others take them as 0.
    """
    spark = panel.sparkSession
    # Features and folds read the panel some times, and each would aggregate its source anew.
    panel = store.saved(panel, shared_path(spark, "panel"))
    frame = regressor_frames(panel, start, cutoffs, keys, order)
    filled = learn.assemble(frame).persist()
    kept = learn.assemble(frame, missing="keep").persist() if "lgbm" in models else None
    jobs = [(cutoff, model) for cutoff in cutoffs for model in models]

    def rows_of(cutoff, model: str) -> DataFrame:
        vectors = kept if model == "lgbm" else filled
        return vectors.where(F.col("cutoff") == F.lit(as_date(cutoff))).drop("cutoff")

    settings = {job: (params or {}).get(job[1]) for job in jobs}
    searched = [job for job in jobs if job[1] in (grids or {})]
    inner = max(1, parallelism // max(1, len(searched)))
    with ThreadPool(max(1, min(parallelism, len(jobs)))) as pool:
        found = pool.starmap(
            lambda cutoff, model: _search(
                rows_of(cutoff, model), model, grids[model], cutoff, inner
            ),
            searched,
            chunksize=1,
        )
        if found:
            saved = saved or shared_path(spark, "regressor-params")
            store.write_params(reduce(DataFrame.unionByName, found), saved)
            for cutoff, model in searched:
                rows = store.read_params(spark, saved, model)
                rows = rows.where(F.col("cutoff") == F.lit(as_date(cutoff)))
                settings[cutoff, model] = learn.best_settings(rows)
        parts = pool.starmap(
            lambda cutoff, model: _forecast(
                rows_of(cutoff, model), model, settings[cutoff, model]
            ).withColumn("cutoff", F.lit(as_date(cutoff))),
            jobs,
            chunksize=1,
        )
    # The fitted models are part of the plan; the forecasts are few rows, so they are kept instead.
    scored = store.saved(score(reduce(DataFrame.unionByName, parts)), shared_path(spark, "forecasts"))
    for vectors in (filled, kept):
        if vectors is not None:
            vectors.unpersist()
    return scored
