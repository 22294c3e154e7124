"""Benchmark decontamination with a positional inverted index over the training documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import (
    ascii_lower,
    bitmap,
    drop_rows,
    maybe_in,
    row_key,
    stored,
    stored_alone,
    text_of,
)

#: Everything but digits, letters a-z and A-Z, and code points from 128 parts words.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a window.
WINDOW_WORDS = 10
#: A side of this many rows at most, of some 60 bytes each, is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 200_000

_KEY = ["_k1", "_k2"]


def words_of(text_col: str = "text") -> Column:
    """Words as they are written; :func:`ascii_lower` on each gives the word to compare."""
    return F.array_remove(F.split(text_of(text_col), SEPARATORS), "")


def _join_small(big: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Inner join: broadcast the small side if its counted rows are few. Else what its bitmap
    clears is left out, and the rest is shuffled by key, where a hot key can be split."""
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on)
    return maybe_in(big, [F.col(c) for c in on], bitmap(small, on)).join(small, on)


@dataclass
class Index:
    """postings (term, _k1, _k2, pos) of the benchmark's terms, and terms (word, term)."""

    postings: DataFrame
    terms: DataFrame


def build_index(
    docs: DataFrame, words: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> Index:
    """Postings of every occurrence of the ``words`` (one column, word) in the documents.

    One pass over the texts; the table is written to the shared folder and read by term or
    document afterwards. Nothing is shuffled while the words' vocabulary is small enough.
    """
    terms = words.distinct()
    terms = stored(terms.withColumn("term", F.monotonically_increasing_id()), "terms")
    tokens = docs.select(
        *row_key(id_col, text_col), F.posexplode(words_of(text_col)).alias("pos", "_raw")
    ).select(*_KEY, "pos", ascii_lower(F.col("_raw")).alias("word"))
    postings = _join_small(tokens, terms, ["word"]).select("term", *_KEY, "pos")
    return Index(stored(postings, "postings"), terms)


def benchmark_windows(
    benchmark: DataFrame,
    size: int = WINDOW_WORDS,
    id_col: str = "item_id",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (window, words), and their items (window, item).

    Every run of ``size`` words of an item is a window; an item of fewer words, but not none, is
    one window. Null texts have no words; an item with a null id has windows but is no item."""
    items = benchmark.select(
        F.col(id_col).cast("string").alias("item"),
        F.transform(words_of(text_col), ascii_lower).alias("_w"),
    ).where("size(_w) > 0")
    cut = items.select(
        "item",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_w") - size + 1)),
                lambda s: F.slice("_w", s, size),
            )
        ).alias("words"),
    )
    cut = stored(cut.distinct(), "windows")
    windows = cut.select("words").distinct()
    windows = stored(windows.withColumn("window", F.monotonically_increasing_id()), "windows")
    return windows, cut.join(windows, "words").select("window", "item")


def ranked_terms(index: Index, windows: DataFrame) -> DataFrame:
    """(window, n, off, term, rank) of the windows whose terms all occur, rarest term first."""
    spread = windows.select(
        "window", F.size("words").alias("n"), F.posexplode("words").alias("off", "word")
    )
    frequency = index.postings.groupBy("term").count()
    known = _join_small(spread, stored(index.terms.join(frequency, "term"), "terms"), ["word"])
    per = Window.partitionBy("window")
    return stored(
        known.withColumns(
            {
                "rank": F.row_number().over(per.orderBy("count", "off")),
                "_found": F.count("*").over(per),
            }
        )
        .where("_found = n")
        .select("window", "n", "off", "term", "rank"),
        "ranked",
    )


def phrase_matches(index: Index, ranked: DataFrame) -> DataFrame:
    """Exact matches (window, _k1, _k2, start, n).

    Each window starts from the postings of its rarest term, moved by the term's offset. The
    second rarest term's postings are intersected next, then those of all others, each time only
    in documents that still have a candidate.
    """
    first = ranked.where("rank = 1").select("window", "n", "off", "term")
    found = _join_small(index.postings, first, ["term"]).select(
        "window", "n", *_KEY, (F.col("pos") - F.col("off")).alias("start")
    )
    found = stored(found.where("start >= 0").distinct(), "candidates")
    for low, high in ((2, 2), (3, 1 << 30)):
        ranks = ranked.where(F.col("rank").between(low, high)).select("window", "off", "term")
        short = found.where(F.col("n") < low)
        wanted = _join_small(found.where(F.col("n") >= low), ranks, ["window"]).withColumn(
            "pos", (F.col("start") + F.col("off")).cast("int")
        )
        nearby = maybe_in(index.postings, [F.col("term")], bitmap(ranks, ["term"]))
        nearby = maybe_in(nearby, [F.col(k) for k in _KEY], bitmap(found, _KEY))
        met = wanted.join(nearby, [*_KEY, "pos", "term"], "left_semi")
        need = F.col("n") - (low - 1) if high > low else F.lit(1)
        whole = met.groupBy("window", "n", *_KEY, "start").count().where(F.col("count") == need)
        found = stored(short.unionByName(whole.drop("count")), "candidates")
    return found


def proximity_matches(index: Index, ranked: DataFrame, slop: int) -> DataFrame:
    """(window, _k1, _k2, pos): places of a window's rarest term that have every other term of the
    window, in any order, within ``slop`` words. Repeated terms of a window count once."""
    cell = F.expr(f"pos div {slop + 1}")
    lists = ranked.groupBy("window", "term").agg(F.min("rank").alias("rank"))
    first = lists.where("rank = 1").select("window", "term")
    at = _join_small(index.postings, first, ["term"]).select("window", *_KEY, "pos").distinct()
    others = lists.where("rank > 1").select("window", "term")
    wanted = _join_small(at, others, ["window"]).withColumn(
        "_cell", F.explode(F.array(cell - 1, cell, cell + 1))
    )
    nearby = maybe_in(index.postings, [F.col(k) for k in _KEY], bitmap(at, _KEY))
    nearby = nearby.select(*_KEY, "term", F.col("pos").alias("_at"), cell.alias("_cell"))
    met = (
        wanted.join(nearby, [*_KEY, "term", "_cell"])
        .where(F.abs(F.col("pos") - F.col("_at")) <= slop)
        .select("window", *_KEY, "pos", "term")
        .distinct()
    )
    sizes = others.groupBy("window").agg(F.count("*").alias("_need"))
    counts = met.groupBy("window", *_KEY, "pos").agg(F.count("*").alias("_have"))
    full = counts.join(sizes, "window").where("_have = _need").select("window", *_KEY, "pos")
    return full.unionByName(at.join(sizes, "window", "left_anti").select("window", *_KEY, "pos"))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = WINDOW_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Documents with a hit: (_k1, _k2, n_hit, n_items, items_sha256).

    ``n_hit`` counts the words inside any occurrence of a window. Rows that repeat id and text are
    one document. Null and empty texts have no words, and an empty table on either side gives an
    empty result."""
    windows, items = benchmark_windows(benchmark, size, item_col, item_text_col)
    vocabulary = windows.select(F.explode("words").alias("word"))
    index = build_index(docs, vocabulary, id_col, text_col)
    found = phrase_matches(index, ranked_terms(index, windows))
    spans = found.select(*_KEY, "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    before = Window.partitionBy(*_KEY).orderBy("start", "end").rowsBetween(
        Window.unboundedPreceding, -1
    )
    fresh = F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))
    words = spans.withColumn("_new", F.greatest(F.lit(0), fresh)).groupBy(*_KEY).agg(
        F.sum("_new").cast("long").alias("n_hit")
    )
    named = _join_small(found.select("window", *_KEY).distinct(), items, ["window"])
    lists = named.groupBy(*_KEY).agg(F.array_sort(F.collect_set("item")).alias("_items"))
    return words.join(lists, _KEY, "left").select(
        *_KEY,
        "n_hit",
        F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("n_items"),
        F.array_join("_items", ",").alias("_list"),
    ).select(
        *_KEY,
        "n_hit",
        "n_items",
        F.sha2(F.coalesce("_list", F.lit("")).cast("binary"), 256).alias("items_sha256"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """The documents without a hit, with all their columns."""
    hit = stored_alone(lambda: contamination(docs, benchmark, size).select(*_KEY), "contaminated")
    return drop_rows(docs, hit)
