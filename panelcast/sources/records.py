"""CSV records of text lines: a quoted field may hold line breaks and doubled quotes.

Spark cuts files into lines in parallel, which tears such a record apart. Whether a line starts
inside a quoted field depends on all lines before it, but each line acts on that one bit in one of
three ways: it keeps it, flips it or sets it. The actions of a block of lines add up to one action,
so the bits follow from a running sum inside each block and one over the blocks of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.session import shared_path
from panelcast.sources.store import saved

#: Lines that a record may have. More mean a quote that is never closed.
RECORD_LINES = 10_000

# The rest of a quoted field behind its opening quote, up to its closing quote; quotes are doubled.
_REST = r'[^"]*+(?:""[^"]*+)*+"(?=,|$)'


def _ends_inside(text: Column) -> Column:
    """Does a text that starts outside of quotes end inside of them?"""
    plain = F.regexp_replace(text, f'(^|,)"{_REST}', "$1")
    return F.when(F.instr(text, '"') > 0, F.regexp_like(plain, F.lit('(^|,)"'))).otherwise(F.lit(False))


def _actions(text: Column) -> dict[str, Column]:
    """``_from_out`` and ``_from_in``: does the line end inside quotes, if it starts out or in?"""
    closes = F.regexp_like(text, F.lit(f"^{_REST}"))
    after = F.regexp_replace(text, f"^{_REST}", "")
    return {
        "_from_out": _ends_inside(text),
        "_from_in": F.when(closes, _ends_inside(after)).otherwise(F.lit(True)),
    }


def _state(first: Column, flips: Column, last_set: Column) -> Column:
    """The bit after some lines: what was set last, or else the first bit, flipped as often as
    lines after that flip it."""
    base = F.coalesce(last_set["value"], first)
    odd = (flips - F.coalesce(last_set["flips"], F.lit(0))) % 2 == 1
    return base != odd


def csv_records(lines: DataFrame) -> DataFrame:
    """Lines (value, _file, _start, _line) -> records with the same columns.

    ``_start`` is the place of a line's block in its file and ``_line`` a number that grows within
    the block. Files without a torn record, the usual case, are not shuffled. A record of several
    lines has line feeds between them, and the place of its first line. A quote that is never closed
    is an error.
    """
    torn = lines.where(_ends_inside(F.col("value"))).select("_file").distinct()
    torn = saved(torn, shared_path(lines.sparkSession, "torn-files"))
    if not torn.limit(1).count():
        return lines
    whole = lines.join(torn, "_file", "left_anti")
    return whole.unionByName(_joined(lines.join(torn, "_file", "left_semi")))


def _joined(lines: DataFrame) -> DataFrame:
    spark = lines.sparkSession
    lines = saved(lines.withColumns(_actions(F.col("value"))), shared_path(spark, "torn-lines"))
    flips = (F.col("_from_out") & ~F.col("_from_in")).cast("long")
    sets = F.col("_from_out") == F.col("_from_in")
    block = Window.partitionBy("_file", "_start").orderBy("_line")
    upto = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = block.rowsBetween(Window.unboundedPreceding, -1)
    acted = lines.withColumn("_flips", F.sum(flips).over(upto))
    mark = F.when(sets, F.struct(F.col("_from_out").alias("value"), F.col("_flips").alias("flips")))
    acted = acted.withColumn("_mark", mark)
    # One action per block, and the bit at the start of each.
    blocks = acted.groupBy("_file", "_start").agg(
        F.sum(flips).alias("_flips"),
        F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.col("_line"))).alias("_mark"),
    )
    earlier = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_flips").over(earlier), F.lit(0)))
    shifted = F.struct(
        F.col("_mark.value").alias("value"), (F.col("_before") + F.col("_mark.flips")).alias("flips")
    )
    blocks = blocks.withColumn("_shifted", F.when(F.col("_mark").isNotNull(), shifted))
    last = F.last("_shifted", ignorenulls=True).over(earlier)
    inside = _state(F.lit(False), F.col("_before"), last)
    starts = blocks.select("_file", "_start", inside.alias("_inside"))
    acted = acted.join(starts, ["_file", "_start"])
    flipped = F.coalesce(F.sum(flips).over(before), F.lit(0))
    inside = _state(F.col("_inside"), flipped, F.last("_mark", ignorenulls=True).over(before))
    opened = (~inside).cast("long")
    numbered = acted.withColumn("_opens", opened).withColumn("_nth", F.sum("_opens").over(upto))
    counts = numbered.groupBy("_file", "_start").agg(F.sum("_opens").alias("_n"))
    base = F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base")
    counts = counts.select("_file", "_start", base)
    rows = numbered.join(counts, ["_file", "_start"]).select(
        "_file", (F.col("_base") + F.col("_nth")).alias("_record"), "_start", "_line", "value"
    )
    rows = saved(rows, shared_path(spark, "record-lines"))
    long = rows.groupBy("_file", "_record").count().where(F.col("count") > RECORD_LINES)
    if bad := long.limit(5).collect():
        raise ValueError(f"a quote is never closed in {[r['_file'] for r in bad]}")
    place = F.sort_array(F.collect_list(F.struct("_start", "_line", "value"))).alias("_x")
    return rows.groupBy("_file", "_record").agg(place).select(
        F.array_join(F.transform("_x", lambda x: x["value"]), "\n").alias("value"),
        "_file",
        F.col("_x")[0]["_start"].alias("_start"),
        F.col("_x")[0]["_line"].alias("_line"),
    )
