"""Column names, dummies, target transform and filling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.expressions import clean_name


def clean_names(df: DataFrame) -> DataFrame:
    """Reduce column names to letters, digits and underscores; fails when two names collide."""
    names = [clean_name(c) for c in df.columns]
    seen: dict[str, str] = {}
    for old, new in zip(df.columns, names):
        if not new or new in seen:
            raise ValueError(f"column {old!r} cleans to {new!r}, already taken or empty")
        seen[new] = old
    return df.toDF(*names)


def category_levels(
    df: DataFrame, columns: Sequence[str], max_levels: int | None = None
) -> dict[str, list[str]]:
    """Sorted distinct values per column, each of which becomes a column of the result.

    With ``max_levels``, refuses columns of more levels. A regressor's many levels are better
    served by the sparse encoder of ``learn.assemble``.
    """
    levels = {}
    for column in columns:
        rows = df.select(column).where(F.col(column).isNotNull()).distinct()
        rows = rows if max_levels is None else rows.limit(max_levels + 1)
        values = sorted(r[0] for r in rows.collect())
        if max_levels is not None and len(values) > max_levels:
            raise ValueError(f"{column} has more than {max_levels} levels; index it instead")
        levels[column] = values
    return levels


def one_hot(
    df: DataFrame, columns: Sequence[str], levels: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Replace each column by one 0/1 column per level, all levels kept."""
    levels = levels or category_levels(df, columns)
    dummies = {
        f"{c}_{value}": F.when(F.col(c) == F.lit(value), 1).otherwise(0)
        for c in columns
        for value in levels[c]
    }
    return df.withColumns(dummies).drop(*columns)


def log_target(df: DataFrame, column: str = "Import") -> DataFrame:
    return df.withColumn(column, F.log1p(column))


def unlog(df: DataFrame, column: str = "prediction", name: str = "pred") -> DataFrame:
    return df.withColumn(name, F.expm1(column))


def fill_zero(df: DataFrame) -> DataFrame:
    """Missing numbers to 0, features and target alike."""
    return df.fillna(0.0)
