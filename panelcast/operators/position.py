"""Global row positions in a given order, without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.session import checkpoint

# Rows of one partition are numbered in the low bits, partitions in the high bits.
_INDEX_BITS = 33


def with_position(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """Add the 0-based position of each row in the total order of ``order``, which must be unique.

    Rows are range-partitioned and sorted, then each partition adds the row count of the partitions
    before it. Only those counts, one row per partition, pass through a single task. The sorted
    rows are checkpointed, since range bounds are sampled and a recomputation could move them.
    """
    tagged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    tagged = checkpoint(tagged)
    part = F.shiftright("_id", _INDEX_BITS).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(part)
        .agg(F.count("*").alias("_n"))
        .select(
            F.col("_part").alias("_offset_part"),
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        )
    )
    index = F.col("_id").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    return (
        tagged.withColumn("_part", part)
        .join(F.broadcast(offsets), F.col("_part") == F.col("_offset_part"))
        .withColumn(name, F.col("_offset") + index)
        .drop("_id", "_part", "_offset", "_offset_part")
    )
