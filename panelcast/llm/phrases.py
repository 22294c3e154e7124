"""Phrases whose words occur together more often than apart, by prefix-free parsing.

Texts are parsed into chunks that begin where the hash of four words falls on a trigger and reach
four words into the next chunk. Equal passages give equal chunks, so a dictionary of distinct chunks
with their frequencies stands for the corpus. N-grams are counted inside distinct chunks, weighted;
each belongs to the one chunk in which it starts before the next trigger, so overlaps count once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.llm.common import arrow_bytes, stored
from panelcast.llm.words import mix, text_blocks
from panelcast.session import ship_package

#: Words of the longest phrase; a chunk reaches one word less into the next.
LONGEST = 5
OVERLAP = LONGEST - 1
#: One window of OVERLAP words in so many is a trigger; a chunk without one ends after the limit,
#: which changes how often chunks repeat but no count.
TRIGGER, CHUNK_LIMIT = 16, 128
#: Bits of the table of frequent phrases that prunes longer ones. A false hit costs work only.
BITS = 1 << 24
#: Slots of the sketch of pairs: so many times the phrases that can be frequent, up to 2^28; its
#: pieces; and the slots that a task holds before it packs them.
SPARSE, MOST_SLOT_BITS, PIECE_BITS, HELD_SLOTS = 32, 28, 6, 1 << 22
#: Bytes of texts that are handed to Python at once.
BATCH_BYTES = 1 << 22
#: Language of a text without one.
NO_LANG = "und"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)  # 0: in a word, 1: between words, 2: between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


class Words:
    """The words of a block of texts: lower-cased bytes, where words start and end, the text and
    the piece of each, and for each distinct word a code and a hash of its content."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = _LOWER[data]
        kind = _KIND[data]
        inside = kind == 0
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        heads = inside.copy()
        heads[1:] &= ~inside[:-1] | edge[1:-1]
        at = np.flatnonzero(inside)
        first = np.flatnonzero(heads[at])
        self.n = len(first)
        self.starts = at[first]
        lengths = np.diff(np.append(first, len(at)))
        self.ends = self.starts + lengths
        self.text = np.searchsorted(offsets, self.starts, "right") - 1
        self.piece = np.cumsum(kind == 2)[self.starts] + self.text if self.n else self.text
        buffer = pa.py_buffer(np.ascontiguousarray(self.data[at]))
        ends = pa.py_buffer(np.append(first, len(at)).astype(np.int64))
        column = pa.Array.from_buffers(pa.large_binary(), self.n, [None, ends, buffer])
        coded = column.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = coded.dictionary
        self.hashes = _content_hashes(coded.dictionary)[self.codes] if self.n else np.zeros(0, np.uint64)

    def after(self, i: int) -> np.ndarray:
        """Is the word ``i`` places further on in the same piece?"""
        same = np.zeros(self.n, bool)
        if self.n > i:
            same[: self.n - i] = self.piece[i:] == self.piece[: self.n - i]
        return same

    def phrases(self, at: np.ndarray, size: int) -> pa.Array:
        """The phrases of ``size`` words that start at words ``at``, with a blank between words."""
        parts = [self.words.take(pa.array(self.codes[at + i])) for i in range(size)]
        joined = parts[0] if size == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))
        return joined.cast(pa.binary()).cast(pa.string())


def _content_hashes(words: pa.Array) -> np.ndarray:
    if not len(words):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    heads, lengths = offsets[:-1] - offsets[0], np.diff(offsets)
    powers = np.multiply.accumulate(np.full(int(lengths.max()), _BASE))
    place = np.arange(len(data)) - np.repeat(heads, lengths)
    sums = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[place], heads)
    return mix(sums + lengths.astype(np.uint64))


def _window_hashes(words: Words, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on (of fewer at the end of the block)."""
    sums = np.zeros(words.n, np.uint64)
    factors = (2 * np.arange(size, dtype=np.uint64) + np.uint64(1)) * _BASE
    for i in range(min(size, words.n)):
        sums[: words.n - i] += words.hashes[i:] * factors[i]
    return mix(sums + np.uint64(size))


def _chunk_bounds(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each chunk, the first word that belongs to the next, and the end of the text
    that it holds: OVERLAP words further, but not beyond the piece of its last own word."""
    at = np.arange(words.n)
    new_text = np.ones(words.n, bool)
    new_text[1:] = words.text[1:] != words.text[:-1]
    whole = np.zeros(words.n, bool)
    last = OVERLAP - 1
    whole[: max(0, words.n - last)] = words.text[last:] == words.text[: max(0, words.n - last)]
    starts = new_text | whole & (_window_hashes(words, OVERLAP) % np.uint64(TRIGGER) == 0)
    since = at - np.maximum.accumulate(np.where(starts, at, 0))
    starts = np.flatnonzero(starts | (since % CHUNK_LIMIT == 0))
    nexts = np.append(starts[1:], words.n)
    piece_end = np.searchsorted(words.piece, words.piece[nexts - 1], "right")
    return starts, nexts, np.minimum(nexts + OVERLAP, piece_end)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, own, chunk, times): own is the number of words that belong to it."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for first, _, data, offsets in text_blocks(batch.column(1), BATCH_BYTES):
            words = Words(data, offsets)
            found: dict = defaultdict(int)
            if words.n:
                text = words.data.tobytes()
                starts, nexts, ends = _chunk_bounds(words)
                rows = zip(
                    words.text[starts].tolist(),
                    (nexts - starts).tolist(),
                    words.starts[starts].tolist(),
                    words.ends[ends - 1].tolist(),
                )
                for row, own, low, high in rows:
                    found[langs[first + row], own, text[low:high]] += 1
            keys = list(found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.string()),
                    pa.array([k[1] for k in keys], pa.int32()),
                    pa.array([k[2] for k in keys], pa.binary()).cast(pa.string()),
                    pa.array(list(found.values()), pa.int64()),
                ],
                ["lang", "own", "chunk", "times"],
            )


def _dense(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of integer keys -> (a place of each distinct row, the distinct row's number of each)."""
    code = keys[0]
    for key in keys[1:]:
        _, code = np.unique(code, return_inverse=True)
        _, key = np.unique(key, return_inverse=True)
        code = code * (int(key.max()) + 1 if len(key) else 1) + key
    _, at, code = np.unique(code, return_index=True, return_inverse=True)
    return at, code


def _has_bit(table: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (table[bits >> np.uint64(3)] >> (bits & np.uint64(7)).astype(np.uint8)) & 1 > 0


class _Candidates:
    """Places of phrases of ``size`` words in a block of chunks that may be frequent: those whose
    beginning and end, of one word less, are."""

    def __init__(self, batch: pa.RecordBatch, first: int, words: Words, size: int, known, langs):
        coded, lang = langs
        self.row = first + words.text
        begins = np.searchsorted(words.text, words.text)
        take = np.arange(words.n) - begins < batch.column(1).to_numpy()[self.row]
        self.lang = lang[self.row]
        seed = _content_hashes(coded.cast(pa.large_binary()))[self.lang]
        if size > 1:
            shorter = mix(_window_hashes(words, size - 1) ^ seed) % np.uint64(BITS)
            frequent = _has_bit(known, shorter)
            take &= words.after(size - 1) & frequent
            take[:-1] &= frequent[1:]
        self.at = np.flatnonzero(take)
        self.hashes = mix(_window_hashes(words, size) ^ seed)[self.at]

    def keep(self, chosen: np.ndarray) -> None:
        self.at, self.hashes = self.at[chosen], self.hashes[chosen]


def _candidates(batches: Iterator[pa.RecordBatch], size: int, known):
    """(batch, languages, words, candidates) of each block of the dictionary's batches."""
    known = np.frombuffer(known, np.uint8) if known is not None else None
    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        langs = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        for first, _, data, offsets in text_blocks(batch.column(2), BATCH_BYTES):
            words = Words(data, offsets)
            if words.n:
                yield batch, langs[0], words, _Candidates(batch, first, words, size, known, langs)


def _phrases_of(size: int, table, heavy):
    """Batches of the dictionary -> (lang, phrase, hash, times) of its phrases of ``size`` words.

    ``table`` holds a bit for each frequent phrase of one word less: a phrase that starts or ends
    with one that is not frequent can't be frequent either and is left out. ``heavy`` holds a bit
    for each slot of a sketch that may hold a frequent phrase.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value if table is not None else None
        for batch, langs, words, found in _candidates(batches, size, known):
            if heavy is not None:
                slots = np.frombuffer(heavy.value, np.uint8)
                found.keep(_has_bit(slots, found.hashes % np.uint64(8 * len(slots))))
            at = found.at
            lang = found.lang[at]
            one, code = _dense(lang, *(words.codes[at + i] for i in range(size)))
            total = np.zeros(len(one), np.int64)
            np.add.at(total, code, batch.column(3).to_numpy()[found.row[at]])
            yield pa.RecordBatch.from_arrays(
                [
                    langs.take(pa.array(lang[one])),
                    words.phrases(at[one], size),
                    pa.array((found.hashes[one] % np.uint64(BITS)).astype(np.int64)),
                    pa.array(total),
                ],
                ["lang", "phrase", "hash", "times"],
            )

    return run


# --- sketch of pairs -------------------------------------------------------------------------


def _sketch(bits: int, table):
    """Batches of the dictionary -> packed counts (piece, n, slots, times) of hash slots of pairs of
    frequent words. A task sums its slots and packs them as sorted steps, which take few bits."""

    def packed(parts: list) -> Iterator[pa.RecordBatch]:
        slots, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        total = np.zeros(len(slots), np.int64)
        np.add.at(total, at, np.concatenate([p[1] for p in parts]))
        piece = slots >> np.uint64(bits - PIECE_BITS)
        ids, cuts = np.unique(piece, return_index=True)
        for i, low, high in zip(ids.tolist(), cuts, [*cuts[1:], len(slots)]):
            steps = np.diff(slots[low:high], prepend=slots.dtype.type(i << (bits - PIECE_BITS)))
            columns = [[i], [int(high - low)]]
            columns += [[_zipped(steps.astype(np.uint32))], [_zipped(total[low:high])]]
            yield pa.RecordBatch.from_pydict(dict(zip(_SKETCH.names, columns)), _SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch, _, _, found in _candidates(batches, 2, table.value):
            slots, at = np.unique(found.hashes % np.uint64(1 << bits), return_inverse=True)
            total = np.zeros(len(slots), np.int64)
            np.add.at(total, at, batch.column(3).to_numpy()[found.row[found.at]])
            parts.append((slots, total))
            held += len(slots)
            if held > HELD_SLOTS:
                yield from packed(parts)
                parts, held = [], 0
        if parts:
            yield from packed(parts)

    return run


_SKETCH = pa.schema(
    [("piece", pa.int32()), ("n", pa.int64()), ("slots", pa.binary()), ("times", pa.binary())]
)


def _zipped(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), "zstd", asbytes=True)


def _heavy(bits: int, least: int):
    """Packed counts, a piece's all in one task -> (piece, a bit per slot: does it reach least?)."""
    size = 1 << (bits - PIECE_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, n, slots, times in zip(*(batch.column(i).to_pylist() for i in range(4))):
                steps = np.frombuffer(pa.decompress(slots, 4 * n, "zstd"), np.uint32)
                values = np.frombuffer(pa.decompress(times, 8 * n, "zstd"), np.int64)
                total = totals.setdefault(piece, np.zeros(size, np.int64))
                total[np.cumsum(steps.astype(np.int64))] += values
        pieces = list(totals)
        marks = [np.packbits(totals[p] >= least, bitorder="little").tobytes() for p in pieces]
        yield pa.RecordBatch.from_arrays(
            [pa.array(pieces, pa.int32()), pa.array(marks, pa.binary())], ["piece", "marks"]
        )

    return run


def heavy_pairs(dictionary: DataFrame, table, least: int, words: int):
    """Bits of the slots in which pairs of frequent words occur ``least`` times together.

    The number of slots follows the corpus, up to a bound: beyond it more slots are heavy by chance,
    which costs work and changes no result. What reaches the driver is one bit per slot.
    """
    wanted = max(1, SPARSE * words // least).bit_length()
    bits = min(max(wanted, PIECE_BITS + 3), MOST_SLOT_BITS)
    parts = dictionary.mapInArrow(
        _sketch(bits, table), "piece int, n long, slots binary, times binary"
    )
    marks = parts.repartition(1 << PIECE_BITS, "piece").mapInArrow(
        _heavy(bits, least), "piece int, marks binary"
    )
    size = 1 << (bits - PIECE_BITS - 3)
    out = bytearray(size << PIECE_BITS)
    for piece, found in marks.collect():
        out[piece * size : (piece + 1) * size] = found
    return dictionary.sparkSession.sparkContext.broadcast(bytes(out))


def _bit_table(spark: SparkSession, frequent: DataFrame):
    """The bits of all frequent phrases' hashes: BITS / 8 bytes, whatever their number."""
    words = frequent.groupBy(F.shiftright("hash", 3).alias("byte")).agg(
        F.expr("bit_or(shiftleft(1, cast(hash & 7 as int)))").alias("bits")
    )
    table = np.zeros(BITS >> 3, np.uint8)
    found = words.select("byte", F.col("bits").cast("int")).toArrow()
    table[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return spark.sparkContext.broadcast(table.tobytes())


def parse(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The dictionary (lang, own, chunk, times) of all texts; null languages count as ``und``."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit(NO_LANG)).alias("lang"), F.col(text_col))
    with arrow_bytes(docs.sparkSession, BATCH_BYTES):
        chunks = rows.mapInArrow(_parse, "lang string, own int, chunk string, times long")
        dictionary = chunks.groupBy("lang", "own", "chunk").agg(F.sum("times").alias("times"))
        return stored(dictionary, "chunks")


def frequent_phrases(dictionary: DataFrame, least: int, total: int) -> DataFrame:
    """(lang, words, phrase, f): all phrases of up to LONGEST words that occur ``least`` times;
    ``total`` is the number of words, which sizes the sketch of pairs."""
    spark = dictionary.sparkSession
    found, table, heavy = [], None, None
    with arrow_bytes(spark, BATCH_BYTES):
        for size in range(1, LONGEST + 1):
            heavy = heavy_pairs(dictionary, table, least, total) if size == 2 else None
            rows = dictionary.mapInArrow(
                _phrases_of(size, table, heavy), "lang string, phrase string, hash long, times long"
            )
            sums = rows.groupBy("lang", "phrase").agg(
                F.sum("times").alias("f"), F.max("hash").alias("hash")
            )
            frequent = stored(sums.where(F.col("f") >= least), f"phrases-{size}")
            found.append(frequent.select("lang", F.lit(size).alias("words"), "phrase", "f"))
            if size < LONGEST:
                table = _bit_table(spark, frequent)
    out = found[0]
    for frame in found[1:]:
        out = out.unionByName(frame)
    return out


def _exact_quotient(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)) in decimals of 38 digits, which hold all products."""
    a, n, left, right = (c.cast("decimal(18,0)") for c in (a, n, left, right))
    top = (a * F.lit(1000).cast("decimal(4,0)")).cast("decimal(20,0)") * n
    return F.call_function("div", top, left * right)


def scored_phrases(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates of two words or more with their lowest-scoring cut: (lang, phrase, a, l, r, n,
    score), without those inside a longer candidate that occurs as often."""
    long = frequent.where("words > 1")
    cuts = long.select("lang", "phrase", F.col("f").alias("a"), "words").withColumn(
        "k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))
    )
    head = F.expr("substring_index(phrase, ' ', k)")
    cuts = cuts.withColumn("head", head).withColumn("rest", F.expr("substring(phrase, length(head) + 2)"))
    part = frequent.where(F.col("words") < LONGEST)
    parts = (
        cuts.join(part.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
        .join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
        .join(totals, "lang")
    )
    score = _exact_quotient(F.col("a"), F.col("n"), F.col("l"), F.col("r"))
    lowest = parts.groupBy("lang", "phrase").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r", "a", "n")).alias("cut")
    )
    # A longer phrase that occurs as often holds one of one word more that does.
    trimmed = F.array(
        F.expr("substring_index(phrase, ' ', words - 1)"),
        F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)"),
    )
    inside = frequent.where("words > 2").select("lang", F.explode(trimmed).alias("phrase"), "f")
    inside = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = lowest.join(inside, ["lang", "phrase"], "left").where(
        "longer IS NULL OR longer < cut.a"
    )
    return kept.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")


def mine_phrases(
    docs: DataFrame,
    least: int = 100,
    top: int = 2000,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """The ``top`` phrases of two to five words of each language, by score, frequency and phrase:
    (lang, rank, phrase, a, l, r, n, score).

    Words and pieces: A-Z are lower-cased; ``.,;:!?`` and line ends part pieces, blanks and tabs
    words. a, l, r are the occurrences of the phrase and of both parts of its lowest-scoring cut, n
    all words of the language, the score floor(1000 * a * n / (l * r)). Null texts have no words, a
    null language is ``und``; copies count as often as they occur; a table without words gives no
    rows. Ties are broken by phrase, so the result is the same in every run. Other columns of
    ``docs`` are not read.
    """
    dictionary = parse(docs, lang_col, text_col)
    own = F.sum(F.col("own").cast("long") * F.col("times"))
    totals = stored(dictionary.groupBy("lang").agg(own.alias("n")), "language-words")
    total = totals.agg(F.sum("n")).first()[0] or 0
    scored = scored_phrases(frequent_phrases(dictionary, least, total), totals)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # filtered as it is, the row number limits what each task sends to a language's last sort
    ranked = scored.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= top)
    return ranked.select(
        "lang", F.col("_nth").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
