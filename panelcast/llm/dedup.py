"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import (
    bitmap,
    drop_rows,
    flag_maybe_in,
    maybe_in,
    row_key,
    stored,
    stored_alone,
    text_of,
)

#: Code points of the prefix that the second step hashes.
PREFIX_CHARS = 64


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = PREFIX_CHARS,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, and the columns in ``carry``.

    Texts are equal when they are identical; of equal texts, the largest id stays.
    1. Lengths in bytes are counted; texts of a length that occurs once are unique.
    2. Of the rest, (length, hash of the prefix) are counted.
    3. Only texts of a class with several members are hashed in full, and grouped by that hash.
    The classes that go on are handed to the next scan as a bitmap of fixed size, so no text is
    ever shuffled. A false hit of the bitmap costs one hash and changes no result.

    Counts are summed before the shuffle. The join that hands a group's result to its rows can be
    split for a hot group, since one side holds one row per group.

    Null texts count as empty. A null id never stays unless all ids of its group are null; then
    keep_id is null and all of them are kept. Rows that repeat the id that stays are the same
    document and are kept as well. An empty table gives an empty result; other columns are ignored.
    """
    text = text_of(text_col)
    length = F.octet_length(text).cast("long")
    prefix = F.xxhash64(F.substring(text, 1, prefix_chars))

    lengths = docs.groupBy(length.alias("_len")).count().where("count > 1")
    longer = maybe_in(docs, [length], bitmap(lengths, ["_len"]))
    prefixes = longer.groupBy(length.alias("_len"), prefix.alias("_pre")).count().where("count > 1")
    open_rows = flag_maybe_in(docs, [length, prefix], bitmap(prefixes, ["_len", "_pre"]), "_open")
    alone = F.concat_ws("/", length.cast("string"), prefix.cast("string"))
    rows = stored(
        open_rows.select(
            F.col(id_col).alias("_id"),
            row_key(id_col, text_col)[1],
            F.when(F.col("_open"), F.sha2(text.cast("binary"), 256)).otherwise(alone).alias("_key"),
            F.col("_open"),
            *[column.alias(name) for name, column in (carry or {}).items()],
        ),
        "dedup",
    )
    groups = (
        rows.where("_open")
        .groupBy("_key")
        .agg(F.max("_id").alias("_keep"), F.count("*").alias("_n"))
        .where("_n > 1")
    )
    # stored, both sides of the join are exchanges, and a hot group can be split
    return rows.join(stored(groups, "dedup-groups"), "_key", "left").select(
        F.col("_id").alias(id_col),
        F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_n", F.lit(1).cast("long")).alias("group_size"),
        (F.col("_n").isNull() | F.col("_id").eqNullSafe(F.col("_keep"))).alias("kept"),
        *(carry or {}),
        F.col("_k2"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""

    def keys() -> DataFrame:
        marked = exact_duplicates(docs, id_col, text_col)
        return marked.where("not kept").select(
            F.coalesce(F.col(id_col).cast("long"), F.lit(-1).cast("long")).alias("_k1"), "_k2"
        )

    return drop_rows(docs, stored_alone(keys, "dedup-dropped"), id_col, text_col)
