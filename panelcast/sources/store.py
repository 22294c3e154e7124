"""Saved tables: scored predictions by year, model and cutoff, and best parameters by key."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.expressions import as_date
from panelcast.session import shared_path


def _write(df: DataFrame, path: str, *partitions: str) -> None:
    """Replace only the partitions that ``df`` holds."""
    (
        df.write.partitionBy(*partitions)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )


def saved(df: DataFrame, path: str) -> DataFrame:
    """Write a table that several later plans read, and read it back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_predictions(scored: DataFrame, path: str) -> None:
    """Save forecasts. Those of another year, model or cutoff stay as they are."""
    named = [c for c in ("model", "cutoff") if c in scored.columns]
    _write(scored.withColumn("year", F.year("Time")), path, "year", *named)


def read_predictions(spark: SparkSession, path: str, year: int | None = None) -> DataFrame:
    """Saved predictions; a year reads its partition only."""
    saved = spark.read.parquet(path)
    return saved if year is None else saved.where(F.col("year") == year)


def _by_name(columns: Sequence[str]) -> Column:
    pairs = [x for c in columns for x in (F.lit(c), F.col(c).cast("string"))]
    return F.create_map(*pairs)


def best_params(tuned: DataFrame, params: Sequence[str]) -> DataFrame:
    """Tidy parameter table of a per-series search, one row per series and cutoff.

    Parameters go into a map from name to text, so that all models share one table.
    """
    return tuned.select(
        "model",
        F.year("cutoff").alias("year"),
        "cutoff",
        "Product",
        "Country",
        _by_name(params).alias("params"),
        "mae",
        "status",
    )


def best_regressor_params(tuned: DataFrame, cutoff: str | date | int) -> DataFrame:
    """The winner of a regressor search as a row of the same table, for no particular series."""
    day = as_date(cutoff)
    none = F.lit(None).cast("string")
    return tuned.where("best").select(
        "model",
        F.lit(day.year).alias("year"),
        F.lit(day).alias("cutoff"),
        none.alias("Product"),
        none.alias("Country"),
        "params",
        F.lit(None).cast("double").alias("mae"),
        F.lit("ok").alias("status"),
    )


_PARAM_KEYS = ("model", "cutoff", "Product", "Country")


def write_params(params: DataFrame, path: str) -> None:
    """Save parameters. Rows of other models, cutoffs and series stay; equal keys are replaced."""
    spark = params.sparkSession
    try:
        before = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        _write(params, path, "model", "year")
        return
    new = saved(params, shared_path(spark, "new-params"))
    touched = before.join(new.select("model", "year").distinct(), ["model", "year"], "left_semi")
    keys = new.select(*[F.col(k).alias(f"_{k}") for k in _PARAM_KEYS])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in _PARAM_KEYS]
    kept = touched.join(keys, same, "left_anti").select(*new.columns)
    merged = saved(kept.unionByName(new), shared_path(spark, "merged-params"))
    _write(merged, path, "model", "year")


def read_params(
    spark: SparkSession, path: str, model: str | None = None, year: int | None = None
) -> DataFrame:
    saved = spark.read.parquet(path)
    if model is not None:
        saved = saved.where(F.col("model") == model)
    return saved if year is None else saved.where(F.col("year") == year)


def with_params(
    series: DataFrame, params: DataFrame, model: str, names: Sequence[str], kind: str = "double"
) -> DataFrame:
    """Give each series its saved parameters of a model as columns; unfitted series drop out."""
    wanted = params.where((F.col("model") == model) & (F.col("status") == "ok")).select(
        "cutoff",
        "Product",
        "Country",
        *[F.col("params")[name].cast(kind).alias(name) for name in names],
    )
    return series.join(wanted, ["cutoff", "Product", "Country"])
