"""Sharding by extendible hashing: only buckets over the byte limit split on another hash bit."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import stored, text_of

#: Bits of the hash that a directory may use.
HASH_BITS = 60
#: Levels that one round of the directory adds below the depth of the round before.
STEP = 8


def hash_bits(key: Column) -> Column:
    """The first 60 bits of MD5 as a long."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def _prefix(depth: int | Column) -> Column:
    if isinstance(depth, int):
        return F.shiftright("_h", HASH_BITS - depth)
    return F.call_function("shiftright", F.col("_h"), F.lit(HASH_BITS) - depth)


def _directory(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Of cells (_cell, _bytes) at depth ``high``: the depth from ``low`` at which each one's
    bucket fits the limit, null where even the cell doesn't fit. Levels are rolled up, each from
    the level below, so they hold two rows per cell together. The joins are sorted merges: a side
    with some rows per shard grows with the data, however small Spark finds it."""
    level = cells.withColumn("_d", F.lit(high))
    levels = level
    for depth in range(high - 1, low - 1, -1):
        level = (
            level.groupBy(F.shiftright("_cell", 1).alias("_cell"))
            .agg(F.sum("_bytes").alias("_bytes"))
            .withColumn("_d", F.lit(depth))
        )
        levels = levels.unionByName(level)
    levels = stored(levels.where(F.col("_bytes") <= limit), "shard-levels")
    first = levels.agg(F.min("_d")).first()[0]
    if first is None:
        return cells.select(F.col("_cell").alias("_leaf"), F.lit(None).cast("int").alias("_depth"))
    # no bucket above the first depth fits, so no leaf need look there
    paths = cells.select(
        F.col("_cell").alias("_leaf"),
        F.explode(F.sequence(F.lit(first), F.lit(high))).alias("_d"),
    ).withColumn("_cell", F.expr(f"shiftright(_leaf, {high} - _d)"))
    found = paths.join(levels.hint("merge"), ["_d", "_cell"]).groupBy("_leaf").agg(F.min("_d").alias("_depth"))
    return cells.select(F.col("_cell").alias("_leaf")).join(found.hint("merge"), "_leaf", "left")


def _assign(rows: DataFrame, limit: int) -> DataFrame:
    """rows (_h, _bytes, ...) with _depth, the bits of the shard that each row belongs to."""
    total = rows.agg(F.sum("_bytes")).first()[0] or 0
    low, high = 0, min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + 4)
    done, rest = None, rows
    while True:
        cells = rest.groupBy(_prefix(high).alias("_cell")).agg(F.sum("_bytes").alias("_bytes"))
        found = stored(_directory(stored(cells, "shard-cells"), low, high, limit), "shard-leaves")
        placed = rest.withColumn("_leaf", _prefix(high)).join(found.hint("merge"), "_leaf").drop("_leaf")
        last = high == HASH_BITS or found.where("_depth is null").isEmpty()
        part = placed.withColumn("_depth", F.coalesce("_depth", F.lit(HASH_BITS))) if last else (
            placed.where("_depth is not null")
        )
        done = part if done is None else done.unionByName(part)
        if last:
            return done
        rest = stored(placed.where("_depth is null").drop("_depth"), "shard-rest")
        low, high = high + 1, min(HASH_BITS, high + STEP)


def _named() -> Column:
    bits = F.lpad(F.bin(_prefix(F.col("_depth"))), HASH_BITS, "0")
    return F.concat(F.lit("s"), F.call_function("right", bits, F.col("_depth")))


def assign_shards(
    docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, shard, depth, shard_bytes, shard_rows.

    A shard is a leaf of the directory: ``s`` and the hash bits it is reached by. It is the
    shallowest bucket of UTF-8 bytes up to ``limit``; a bucket over the limit splits on its next
    bit. Bytes are summed per hash prefix before any shuffle, so no key is hot.

    Rows that repeat an id share all bits. Where such rows alone exceed the limit, they are hashed
    anew together with a row number and split the same way; the second bits follow a ``+``. Only a
    single text over the limit makes a shard over it. Null ids hash as empty, null texts have no
    bytes; an empty table gives an empty result; other columns are ignored.
    """
    rows = stored(
        docs.select(
            F.col(id_col).alias("_id"),
            hash_bits(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("_h"),
            F.octet_length(text_of(text_col)).cast("long").alias("_bytes"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "shard-rows",
    )
    placed = stored(_assign(rows, limit).withColumn("shard", _named()), "shard-placed")
    sizes = placed.groupBy("shard").agg(
        F.sum("_bytes").alias("shard_bytes"), F.count("*").alias("shard_rows")
    )
    stuck = placed.join(
        sizes.where((F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)).select("shard"),
        "shard",
        "left_semi",
    )
    if not stuck.isEmpty():
        anew = stuck.withColumns(
            {"_first": F.col("shard"), "_h": hash_bits(F.concat_ws("/", "_h", "_row"))}
        ).drop("shard", "_depth")
        again = _assign(stored(anew, "shard-anew"), limit)
        again = again.withColumn("shard", F.concat_ws("+", "_first", _named()))
        again = again.withColumn("_depth", F.col("_depth") + HASH_BITS)
        placed = stored(
            placed.join(stuck.select("shard").distinct(), "shard", "left_anti")
            .select("_id", "_bytes", "_depth", "shard")
            .unionByName(again.select("_id", "_bytes", "_depth", "shard")),
            "shard-placed",
        )
        sizes = placed.groupBy("shard").agg(
            F.sum("_bytes").alias("shard_bytes"), F.count("*").alias("shard_rows")
        )
    return placed.join(sizes.hint("merge"), "shard").select(
        F.col("_id").alias(id_col),
        F.col("_bytes").alias("n_bytes"),
        "shard",
        F.col("_depth").cast("long").alias("depth"),
        "shard_bytes",
        "shard_rows",
    )


def write_shards(docs: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write ``docs`` as Parquet, one folder per shard. Ids must be unique; every shard fits one
    task by its byte limit."""
    placed = docs.join(shards.select(id_col, "shard"), id_col)
    placed.repartition("shard").write.partitionBy("shard").parquet(path)
