"""Operators on the long panel ``(Country, Product, Time, Import)``; Time is the first of a month.

(Country, Product, Time) is unique, so a series never holds more rows than the calendar has months
between the bounds. Every per-series array below relies on that bound.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.expressions import add_months, as_date, null_if_nan
from panelcast.session import shuffle_partitions

KEYS = ("Country", "Product")
Day = str | date | int


def months_between(start: Day, end: Day) -> int:
    a, b = as_date(start), as_date(end)
    return (b.year - a.year) * 12 + b.month - a.month


def within_period(panel: DataFrame, start: Day, end: Day) -> DataFrame:
    """Rows with start <= Time < end; a plain range filter, so it reaches a Parquet scan."""
    return panel.where(
        (F.col("Time") >= F.lit(as_date(start))) & (F.col("Time") < F.lit(as_date(end)))
    )


def select_countries(panel: DataFrame, countries: Sequence[str] | None = None) -> DataFrame:
    """Keep the chosen countries; all of them by default."""
    return panel if countries is None else panel.where(F.col("Country").isin(list(countries)))


def offset_values(panel: DataFrame, offset: float = 1.0) -> DataFrame:
    """Shift every value, so that no value is zero. Scores are computed on this scale."""
    return panel.withColumn("Import", F.col("Import") + F.lit(offset))


def date_parts(panel: DataFrame) -> DataFrame:
    return panel.withColumns({"month": F.month("Time"), "year": F.year("Time")})


def label_split(panel: DataFrame, cutoff: Day) -> DataFrame:
    """Mark rows before the cutoff as train and the others as test."""
    before = F.col("Time") < F.lit(as_date(cutoff))
    return panel.withColumn("split", F.when(before, "train").otherwise("test"))


def _months_with_value(inside: Column | None = None) -> Column:
    """Aggregate: the distinct months that hold a value. The calendar bounds the set."""
    has_value = F.col("Import").isNotNull() & ~F.isnan("Import")
    found = has_value if inside is None else inside & has_value
    return F.size(F.collect_set(F.when(found, F.col("Time"))))


def _month_counts(start: Day, end: Day, keys: Sequence[str]) -> dict[str, Column]:
    months = F.collect_set(F.when(F.col("Import").isNotNull() & ~F.isnan("Import"), F.col("Time")))
    present = F.size(months.over(Window.partitionBy(*keys)))
    return {"_present": present, "_expected": F.lit(months_between(start, end))}


def complete_series(
    panel: DataFrame, start: Day, end: Day, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Rows in the period, of series that have a value for each of its months.

    Months are counted once, so a repeated month doesn't stand in for a missing one.

    The count is a window over the series, so the panel is read and shuffled once, and later
    per-series operators reuse that partitioning.
    """
    counted = within_period(panel, start, end).withColumns(_month_counts(start, end, keys))
    return counted.where("_present = _expected").drop("_present", "_expected")


def incomplete_series(
    panel: DataFrame, start: Day, end: Day, keys: Sequence[str] = KEYS
) -> DataFrame:
    """One row per series of the panel that lacks months in the period, with how many."""
    expected = months_between(start, end)
    inside = (F.col("Time") >= F.lit(as_date(start))) & (F.col("Time") < F.lit(as_date(end)))
    missing = F.lit(expected) - _months_with_value(inside)
    return (
        panel.groupBy(*keys).agg(missing.cast("int").alias("missing")).where(F.col("missing") > 0)
    )


def by_series(panel: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Hash-partition by series, with an explicit count.

    Fitting costs far more than its few bytes suggest, so the size-based merging of small
    partitions must not apply here.
    """
    return panel.repartition(shuffle_partitions(panel.sparkSession), *keys)


def densify(
    panel: DataFrame, start: Day, end: Day, fill: float = 0.0, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Every series gets one row for each month of the period; missing values become ``fill``.

    One grouping per series and no join: the months are looked up in a map of at most one entry
    per calendar month.
    """
    inside = (F.col("Time") >= F.lit(as_date(start))) & (F.col("Time") < F.lit(as_date(end)))
    last = add_months(as_date(end), -1)
    months = F.sequence(F.lit(as_date(start)), F.lit(last), F.expr("interval 1 month"))
    return (
        panel.withColumn("_value", F.when(inside, F.struct("Time", null_if_nan("Import"))))
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list("_value")).alias("_known"))
        .select(*keys, F.explode(months).alias("Time"), "_known")
        .select(
            *keys,
            "Time",
            F.coalesce(F.try_element_at("_known", "Time"), F.lit(fill)).alias("Import"),
        )
    )


def split_series(
    panel: DataFrame,
    start: Day,
    cutoffs: Sequence[Day],
    horizon: int = 12,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """One row per series and cutoff, ready for fitting, from a single shuffle.

    Columns: keys, ``cutoff date``, ``y array<double>`` (months from start up to the cutoff),
    ``actual array<double>`` (the ``horizon`` months from the cutoff) and ``status``: ``ok``,
    ``incomplete_train`` or ``incomplete_test``. Nothing is dropped here, callers filter on status.
    """
    first = as_date(start)
    days = [as_date(c) for c in cutoffs]
    end = add_months(max(days), horizon)
    value = F.struct("Time", null_if_nan("Import").alias("Import"))
    series = (
        by_series(within_period(panel, first, end), keys)
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(value)).alias("_known"))
        .withColumn("cutoff", F.explode(F.array(*[F.lit(d) for d in days])))
    )
    step = F.expr("interval 1 month")

    def values(begin: Column, last: Column) -> Column:
        return F.transform(
            F.sequence(begin, last, step), lambda month: F.try_element_at("_known", month)
        )

    arrays = series.select(
        *keys,
        "cutoff",
        values(F.lit(first), F.add_months("cutoff", -1)).alias("y"),
        values(F.col("cutoff"), F.add_months("cutoff", horizon - 1)).alias("actual"),
    )
    status = (
        F.when(F.exists("y", lambda v: v.isNull()), "incomplete_train")
        .when(F.exists("actual", lambda v: v.isNull()), "incomplete_test")
        .otherwise("ok")
    )
    return arrays.withColumn("status", status)


def forecast_rows(
    series: DataFrame, pred: str = "pred", model: str = "model", keys: Sequence[str] = KEYS
) -> DataFrame:
    """Unfold ``pred`` and ``actual`` into ``forecast(keys, cutoff, Time, model, pred, real)``.

    Step h of a forecast belongs to the month ``cutoff + h - 1``.
    """
    steps = F.arrays_zip(F.col(pred).alias("pred"), F.col("actual").alias("real"))
    return series.select(*keys, "cutoff", F.col(model).alias("model"), F.posexplode(steps)).select(
        *keys,
        "cutoff",
        F.add_months("cutoff", F.col("pos")).alias("Time"),
        "model",
        F.col("col.pred").alias("pred"),
        F.col("col.real").alias("real"),
    )


def difference(
    panel: DataFrame, d: int = 0, seasonal: int = 0, period: int = 12, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Differenced values; NULL until enough earlier values exist."""
    w = Window.partitionBy(*keys).orderBy("Time")
    out = panel
    for lag in [1] * d + [period] * seasonal:
        out = out.withColumn("Import", F.col("Import") - F.lag("Import", lag).over(w))
    return out
