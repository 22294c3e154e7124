"""Contiguous folds and standardisation for the regressors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.position import with_position

# Rows stand in blocks of whole series, so that contiguous folds mostly hold out whole series.
ROW_ORDER = ("Product", "Country", "Time")


def fold_of(position: Column, total: int, folds: int = 5) -> Column:
    """Fold of a 0-based position: contiguous, sizes differ by at most one, larger folds first."""
    size, larger = divmod(total, folds)
    head = larger * (size + 1)
    late = F.lit(larger) + F.floor((position - head) / max(size, 1))
    return (
        F.when(position < head, F.floor(position / (size + 1))).otherwise(late).cast("int")
    )


def with_folds(
    df: DataFrame, folds: int = 5, order: Sequence[str] = ROW_ORDER, name: str = "fold"
) -> DataFrame:
    """Number rows in order and cut them into contiguous folds. The result is checkpointed."""
    placed = with_position(df, order, "_pos")
    return placed.withColumn(name, fold_of(F.col("_pos"), placed.count(), folds)).drop("_pos")


def standardize(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Centre and scale columns with the mean and population deviation of ``fit_on``.

    A constant column is only centred.
    """
    source = df if fit_on is None else fit_on
    stats = source.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    scaled = {
        c: (F.col(c) - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"] or 1.0)
        for i, c in enumerate(columns)
        if stats[f"m{i}"] is not None
    }
    return df.withColumns(scaled)
