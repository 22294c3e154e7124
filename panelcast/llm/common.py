"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.session import shared_path

#: Bits of a survivor bitmap. It is broadcast as at most BITMAP_BITS / 64 rows of 16 bytes: 1 MiB.
BITMAP_BITS = 1 << 22


#: Tables stored since :func:`stored_alone` began, in this thread.
_ON_THE_WAY: ContextVar[list[DataFrame] | None] = ContextVar("on_the_way", default=None)


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors. The
    shuffle files of the write go with its end, since nothing reads them again."""
    path = shared_path(df.sparkSession, name)
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", codec).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    if (tables := _ON_THE_WAY.get()) is not None:
        tables.append(table)
    return table


def stored_alone(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``build`` returns, stored. The tables that it stores on its way are deleted then, so
    nothing but the result may still be read."""
    around = _ON_THE_WAY.set([])
    try:
        table = stored(build(), name)
        *passed, _ = _ON_THE_WAY.get()
    finally:
        _ON_THE_WAY.reset(around)
    for other in passed:
        discard(other)
    if (tables := _ON_THE_WAY.get()) is not None:
        tables.append(table)
    return table


def discard(table: DataFrame) -> None:
    """Delete a table that :func:`stored` has written, once nothing will read it again. A second
    time does nothing."""
    context = table.sparkSession.sparkContext
    for file in table.inputFiles()[:1]:
        folder = context._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the actions inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Hand at most so many rows to Python at once, for actions inside: it bounds their memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def arrow_bytes(spark: SparkSession, limit: int) -> Iterator[None]:
    """Hand batches of about so many bytes to Python, for actions inside: it bounds their memory
    whatever the length of a row, which a number of rows does not."""
    with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(limit)):
        yield


def text_of(name: str = "text") -> Column:
    """A text column with null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Two longs that stand for a row: null ids and repeated ids with other texts stay apart."""
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(-1).cast("long")).alias("_k1"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("_k2"),
    ]


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only. Whole words that ``lower`` leaves alone skip the slow translation."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.lower(column) == column, column).otherwise(
        F.translate(column, upper, upper.lower())
    )


def _bit(columns: list[Column]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BITMAP_BITS))


def bitmap(keys: DataFrame, columns: list[str]) -> DataFrame:
    """Fixed-size bitmap of the keys' hashes, as rows (_word, _bits): a one-hash Bloom filter."""
    return (
        keys.select(_bit([F.col(c) for c in columns]).alias("_b"))
        .groupBy(F.expr("shiftright(_b, 6)").alias("_word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(_b & 63 as int)))").alias("_bits"))
    )


def _probe(columns: list[Column], words: DataFrame) -> Column:
    bit = _bit(columns)
    return (F.shiftright(bit, 6) == words["_word"]) & (
        F.call_function("shiftrightunsigned", words["_bits"], bit.bitwiseAND(F.lit(63)).cast("int"))
        .bitwiseAND(F.lit(1))
        == 1
    )


def maybe_in(df: DataFrame, columns: list[Column], words: DataFrame) -> DataFrame:
    """Rows whose key may be in the bitmap: never loses one that is, and shuffles nothing."""
    return df.join(F.broadcast(words), _probe(columns, words), "left_semi")


def surely_out(df: DataFrame, columns: list[Column], words: DataFrame) -> DataFrame:
    """The rows that :func:`maybe_in` leaves out."""
    return df.join(F.broadcast(words), _probe(columns, words), "left_anti")


def flag_maybe_in(df: DataFrame, columns: list[Column], words: DataFrame, name: str) -> DataFrame:
    """All rows, with a boolean: may the key be in the bitmap?"""
    found = df.join(F.broadcast(words), _probe(columns, words), "left")
    return found.withColumn(name, F.col("_word").isNotNull()).drop("_word", "_bits")


def drop_rows(df: DataFrame, dropped: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Rows of df whose key is not among ``dropped`` (_k1, _k2).

    Only rows that the bitmap can't clear go through the exact join; the others are not shuffled.
    """
    words = bitmap(dropped, ["_k1", "_k2"])
    keys = row_key(id_col, text_col)
    clear = surely_out(df, keys, words)
    k1, k2 = keys
    unsure = maybe_in(df, keys, words)
    exact = unsure.withColumns({"_k1": k1, "_k2": k2}).join(dropped, ["_k1", "_k2"], "left_anti")
    return clear.unionByName(exact.select(*[F.col(f"`{c}`") for c in df.columns]))


def stars(links: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of undirected links (a, b): rows (id, component), the smallest id. The
    smallest ids themselves have no row.

    Alternating large-star and small-star rounds. Minima are aggregated before they are joined
    back, so the neighbours of a hub are never gathered in one place; every round is stored, and
    deleted once the next one is. Rounds end when all that is left are stars, which takes one
    round where the links are stars already.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").distinct(), name)
        if before is not None:
            discard(before)
        before = edges
        # in stars, an id has one edge to a smaller one or is the smaller one of edges, never both
        ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.unionByName(edges.select(F.col("v").alias("id"), F.lit(0), F.lit(1)).toDF(*ends.columns))
        ends = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not ends.where("up + down > 1").agg(F.count("*")).first()[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of undirected links (a, b): rows (id, component), the smallest id."""
    edges = stars(links, name)
    roots = edges.select(F.col("component").alias("id")).distinct()
    return edges.unionByName(roots.select("id", F.col("id").alias("component")))
