"""Wide reports (one row per importer, one column per month) to and from the long panel."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from datetime import date, datetime
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.expressions import MONTH_FORMATS, as_date, null_if_nan
from panelcast.session import shared_path
from panelcast.sources.records import csv_records
from panelcast.sources.store import saved

ID = "Importers"


def month_of(label: str, formats: Sequence[str] = tuple(MONTH_FORMATS)) -> date | None:
    """First day of the month of one header label, or None when no listed format fits in full."""
    for fmt in formats:
        try:
            day = datetime.strptime(label, MONTH_FORMATS[fmt]).date()
        except ValueError:
            continue
        # strptime also takes a month of one digit, which the column parser does not
        if day.strftime(MONTH_FORMATS[fmt]) == label:
            return day.replace(day=1)
    return None


def month_columns(
    columns: Sequence[str],
    start: str | date | int | None = None,
    end: str | date | int | None = None,
    formats: Sequence[str] = tuple(MONTH_FORMATS),
) -> dict[str, date]:
    """Month columns within [start, end). An unreadable header is an error, never a guess.

    Unpivoting hides the month from the scan, so the period is applied to the header instead.
    """
    months = {}
    for column in columns:
        if column == ID:
            continue
        month = month_of(column, formats)
        if month is None:
            raise ValueError(f"month header {column!r} fits none of {list(formats)}")
        if (start is None or month >= as_date(start)) and (end is None or month < as_date(end)):
            months[column] = month
    return months


def unpivot_months(
    wide: DataFrame, ids: Sequence[str], months: dict[str, date], value: str = "Import"
) -> DataFrame:
    """Wide to long: one row per importer and month, with a real date. Missing cells stay NULL."""
    typed = wide.select(*ids, *[F.col(f"`{c}`").try_cast("double").alias(c) for c in months])
    long = typed.unpivot(list(ids), [f"`{c}`" for c in months], "Label", value)
    # Every label was read above, so each one has a date in this constant map.
    dates = F.create_map(*[F.lit(x) for pair in months.items() for x in pair])
    return long.select(
        *ids,
        "Label",
        F.try_element_at(dates, "Label").alias("Time"),
        null_if_nan(value).alias(value),
    )


def pivot_months(panel: DataFrame, months: dict[str, date]) -> DataFrame:
    """Long to wide: ``Product, Importers`` and one column per month label."""
    named = panel.select("Product", F.col("Country").alias(ID), "Time", "Import")
    wide = named.groupBy("Product", ID).pivot("Time", list(months.values())).agg(F.max("Import"))
    return wide.toDF("Product", ID, *months)


def write_wide_reports(
    panel: DataFrame, path: str, reports: dict[str, dict[str, date]], format: str = "csv"
) -> None:
    """Write ``<path>/<report>/product=<p>/*``, one report per entry of month columns.

    The panel is pivoted once for all reports, and dealt by product and part of the importers, so
    that a product fills a few files. A report holds the importers with a value in it.
    """
    months = {label: day for part in reports.values() for label, day in part.items()}
    wide = pivot_months(panel, months).withColumnRenamed("Product", "product")
    wide = wide.repartition("product", F.pmod(F.xxhash64(ID), F.lit(8))).persist()
    for name, part in reports.items():
        report = wide.where(F.coalesce(*[F.col(f"`{c}`") for c in part]).isNotNull())
        report = report.select("product", ID, *[F.col(f"`{c}`") for c in part])
        # quotes are doubled and spaces kept; Parquet ignores these options
        rules = {"header": True, "escape": '"'}
        rules |= {f"ignore{side}WhiteSpace": False for side in ("Leading", "Trailing")}
        out = report.write.partitionBy("product").options(**rules)
        out.format(format).save(f"{path}/{name}")
    wide.unpersist()


def _decoded(text: Column) -> Column:
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def _product_of(file: str) -> Column:
    """Product of a file URL: its folder. A ``product=`` folder was escaped once more on writing."""
    folder = F.regexp_extract(_decoded(F.col(file)), "/([^/]+)/[^/]+$", 1)
    value = F.regexp_replace(folder, "^product=", "")
    return F.when(folder.startswith("product="), _decoded(value)).otherwise(folder)


#: Files of which one row each is broadcast to the rows; beyond that both sides are shuffled.
BROADCAST_FILES = 100_000


def _first_lines(lines: DataFrame) -> DataFrame:
    """(file, header): the first line of each file, as one small aggregate per file."""
    order = F.struct("_start", "_line")
    return lines.groupBy("_file").agg(F.min_by("value", order).alias("header"))


def _by_file(rows: DataFrame, files: DataFrame) -> DataFrame:
    few = files.count() <= BROADCAST_FILES
    return rows.join(F.broadcast(files) if few else files, "_file")


def _counted(files: DataFrame) -> DataFrame:
    """Files with ``n_reports``, the number of reports of their product."""
    counts = files.groupBy("Product").agg(F.countDistinct("report").cast("int").alias("n_reports"))
    return files.join(counts, "Product")


def _layouts(headers: Sequence[str], start, end, formats) -> list[tuple]:
    """(header, report, place of the importer, month of each column) of the distinct headers."""
    out = []
    for report, header in enumerate(sorted(headers)):
        columns = [c.strip() for c in next(csv.reader([header]))]
        months = month_columns(columns, start, end, formats)
        out.append((header, report, columns.index(ID), [months.get(c) for c in columns]))
    return out


def _csv_cells(spark: SparkSession, path: str, start, end, formats, pattern) -> DataFrame:
    lines = csv_records(
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_line"),
        )
    )
    firsts = saved(_first_lines(lines), shared_path(spark, "headers"))
    # The distinct headers are what the driver needs to know; their number does not grow with files.
    headers = [r.header for r in firsts.select("header").distinct().collect()]
    if not headers:
        raise ValueError(f"no report below {path}")
    bad = [h for h in headers if ID not in [c.strip() for c in next(csv.reader([h]), [])]]
    if bad:
        names = firsts.where(F.col("header").isin(bad)).limit(5).select("_file").collect()
        raise ValueError(f"no column {ID!r} in the header of {[unquote(r._file) for r in names]}")
    layouts = _layouts(headers, start, end, formats)
    known = spark.createDataFrame(
        layouts, "header string, report int, _id int, _months array<date>"
    )
    files = firsts.join(known, "header").withColumn("Product", _product_of("_file"))
    files = saved(_counted(files), shared_path(spark, "files"))
    width = max(len(months) for *_, months in layouts)
    fields = ", ".join(f"c{i} string" for i in range(width))
    rows = _by_file(lines, files).where("value <> header and trim(value) <> ''")
    parsed = rows.withColumn("_row", F.from_csv("value", fields, {"escape": '"'})).withColumn(
        "_cells", F.array(*[F.col(f"_row.c{i}") for i in range(width)])
    )
    inside = F.filter(
        F.arrays_zip(F.col("_months").alias("Time"), F.col("_cells").alias("cell")),
        lambda x: x["Time"].isNotNull(),
    )
    # Importers of a report outside the period still count for presence in all reports.
    return parsed.select(
        "Product",
        F.get("_cells", F.col("_id")).alias(ID),
        "report",
        "n_reports",
        F.explode_outer(inside).alias("x"),
    ).select(
        "Product",
        ID,
        "report",
        "n_reports",
        F.col("x.Time").alias("Time"),
        null_if_nan(F.col("x.cell").try_cast("double")).alias("Import"),
    )


def _parquet_cells(spark: SparkSession, path: str, start, end, formats) -> DataFrame:
    wide = (
        spark.read.option("mergeSchema", True)
        .option("recursiveFileLookup", True)
        .parquet(path)
        .withColumn("_file", F.col("_metadata.file_path"))
    )
    columns = [c for c in wide.columns if c not in ("_file", "product")]
    if ID not in columns:
        raise ValueError(f"no column {ID!r} below {path}")
    every = month_columns(columns, None, None, formats)
    months = month_columns(columns, start, end, formats)
    # A folder holds the months for which it has any value; the merged schema no longer tells.
    has = [F.when(F.max(F.col(f"`{c}`").isNotNull()), F.lit(c)) for c in every]
    folder = F.regexp_replace("_file", "/[^/]+$", "/")
    wide = wide.withColumns({"_file": folder, "Product": _product_of("_file")})
    files = wide.groupBy("_file", "Product").agg(F.array_compact(F.array(*has)).alias("_labels"))
    files = saved(files, shared_path(spark, "files"))
    layouts = sorted(r._labels for r in files.select("_labels").distinct().collect())
    known = spark.createDataFrame(list(enumerate(layouts)), "report int, _labels array<string>")
    files = _counted(files.join(known, "_labels"))
    rows = _by_file(wide.drop("Product"), saved(files, shared_path(spark, "files")))
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("label"),
                F.lit(day).alias("Time"),
                null_if_nan(F.col(f"`{c}`").try_cast("double")).alias("Import"),
            )
            for c, day in months.items()
        ]
    ) if months else F.array().cast("array<struct<label:string,Time:date,Import:double>>")
    held = F.filter(cells, lambda x: F.array_contains("_labels", x["label"]))
    return rows.select(
        "Product", ID, "report", "n_reports", F.explode_outer(held).alias("x")
    ).select("Product", ID, "report", "n_reports", "x.Time", "x.Import")


def read_wide_reports(
    spark: SparkSession,
    path: str,
    start: str | date | int | None = None,
    end: str | date | int | None = None,
    format: str = "csv",
    formats: Sequence[str] = tuple(MONTH_FORMATS),
    pattern: str = "*.csv",
) -> DataFrame:
    """All wide files below ``path``: ``Product, Importers, report, n_reports, Time, Import``.

    The product is the name of the folder that holds a file (a ``product=`` prefix is dropped).
    Files of a product with equal months are parts of one report; ``n_reports`` is the number of
    reports of that product. Empty cells stay as NULL values in both formats.

    ``pattern`` picks the CSV files by name. Every one must have a header with the importers' column, in any place and with spaces
    around names, and months elsewhere: any other file is an error that names it. A quoted field may
    hold line breaks, which are read as line feeds, and doubled quotes. One scan looks for such
    records, one reads all headers and one all rows. Parquet files of one folder are parts of one
    report, and a month without any value in a folder counts as absent from it.
    """
    if format == "parquet":
        return _parquet_cells(spark, path, start, end, formats)
    return _csv_cells(spark, path, start, end, formats, pattern)


def _reconciled(reports: DataFrame) -> DataFrame:
    """One row per product, importer and month, with how the reports agree on it."""
    return reports.groupBy("Product", ID, "Time").agg(
        F.max("Import").alias("Import"),
        F.min("Import").alias("low"),
        F.count("Import").alias("n_values"),
        F.count("*").alias("n_rows"),
        F.collect_set("report").alias("in_reports"),
        F.max("n_reports").alias("n_reports"),
    )


def _agrees() -> Column:
    same = F.col("n_values").isin(0) | (
        (F.col("n_values") == F.col("n_rows")) & (F.col("low") == F.col("Import"))
    )
    return F.coalesce(same, F.lit(False))


def wide_conflicts(reports: DataFrame) -> DataFrame:
    """Months that several reports carry with different values, one row each."""
    return (
        _reconciled(reports)
        .where(F.col("Time").isNotNull() & ~_agrees())
        .select("Product", F.col(ID).alias("Country"), "Time", "low", F.col("Import").alias("high"))
    )


def join_reports(reports: DataFrame) -> DataFrame:
    """The panel of importers that appear in every report of their product, without conflicts.

    Gives what a natural inner join of the wide reports gives, in long form: one aggregation by
    month and one by importer, with any number of reports. NULL importers match each other.
    """
    months = _reconciled(reports).withColumn("ok", _agrees() | F.col("Time").isNull())
    importer = months.groupBy("Product", ID).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("in_reports")))).alias("n_seen"),
        F.max("n_reports").alias("n_reports"),
        F.bool_and("ok").alias("ok"),
        F.collect_list(F.struct("Time", "Import")).alias("rows"),
    )
    kept = importer.where(F.col("ok") & (F.col("n_seen") == F.col("n_reports")))
    return (
        kept.select("Product", F.col(ID).alias("Country"), F.explode("rows").alias("r"))
        .select("Country", "Product", F.col("r.Time").alias("Time"), F.col("r.Import").alias("Import"))
        .where("Time IS NOT NULL")
    )
