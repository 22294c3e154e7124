"""Token counts of whole texts under a byte-level BPE vocabulary, without ids.

Such a tokenizer cuts a text into pre-tokens and merges inside each of them alone, so a text's
count is the sum of its pre-tokens' counts. Every distinct pre-token of the corpus is encoded once;
its length is then joined to the pre-token frequencies of each document and summed.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import arrow_bytes, stored
from panelcast.session import ship_package

#: Pre-tokens of a document that one row holds; a document with more has several rows.
ROW_PIECES = 1 << 13
#: The most frequent pre-tokens are broadcast: at most so many, of so many bytes each.
HEAD_PIECES, HEAD_BYTES = 1 << 17, 64
#: Bytes of texts that are handed to Python at once.
BATCH_BYTES = 1 << 21

#: The pre-tokens of the vocabulary's files: fixed pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points that every version of Unicode in use classes alike. A text with another one is cut
#: by the library itself, which is slower.
SETTLED = (
    r"[\u0000-՗֐-ࢎഀ-₎₠-ꟍ가-퟿-￿"
    r"\U0001f000-\U0001f9ff]*"
)


def load_tokenizer(path: str) -> str:
    """The tokenizer file's text, read on the driver. Only byte-level BPE can be counted so."""
    found = Path(path).read_text(encoding="utf-8")
    parsed = json.loads(found)
    cut = parsed.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
    if not plain or cut.get("add_prefix_space") or parsed.get("normalizer"):
        raise ValueError("the tokenizer must cut texts as byte-level BPE does, unnormalised")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in parsed["added_tokens"]):
        raise ValueError("special strings must stand for themselves alone")
    return found


def special_strings(tokenizer: str) -> list[str]:
    """Strings that the tokenizer takes out of a text as one token each, before it cuts the rest."""
    return [t["content"] for t in json.loads(tokenizer)["added_tokens"]]


def _cutter(specials: list[str]):
    """text -> its pre-tokens and special strings, in order."""
    import regex
    from tokenizers import pre_tokenizers

    pattern, settled = regex.compile(PATTERN), regex.compile(SETTLED)
    library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    apart = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True))))

    def cut(part: str) -> Iterator[str]:
        if settled.fullmatch(part):
            return (m.group() for m in pattern.finditer(part))
        return (part[a:b] for _, (a, b) in library.pre_tokenize_str(part))

    def pieces(text: str) -> Iterator[str]:
        at = 0
        for m in apart.finditer(text) if specials else ():
            yield from cut(text[at : m.start()])
            yield m.group()
            at = m.end()
        yield from cut(text[at:] if at else text)

    return pieces


def _frequencies(specials: list[str], schema: pa.Schema):
    """Arrow batches of (row, id, text) -> rows (row, id, n_bytes, pieces), some for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _cutter(specials)
        for batch in batches:
            take, sizes, ends, pieces, counts = [], [], [0], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                text = text or ""
                found = Counter(cut(text))
                names, times = list(found), list(found.values())
                for low in range(0, max(1, len(names)), ROW_PIECES):
                    pieces += names[low : low + ROW_PIECES]
                    counts += times[low : low + ROW_PIECES]
                    take.append(i)
                    sizes.append(len(text.encode()) if not low else 0)
                    ends.append(len(pieces))
            struct = pa.StructArray.from_arrays(
                [pa.array(pieces, pa.string()), pa.array(counts, pa.int64())], ["piece", "times"]
            )
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)
            rows = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(sizes, pa.int64()), lists], schema=schema
            )

    return run


def _lengths(tokenizer):
    """Arrow batches with a column ``piece`` -> the same with the number of its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_str(tokenizer.value)
        for batch in batches:
            found = model.encode_batch_fast(batch.column(0).to_pylist(), add_special_tokens=False)
            sizes = pa.array([len(x.ids) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, sizes], ["piece", "times", "n"])

    return run


def _head(lengths: DataFrame) -> DataFrame:
    """The most frequent pre-tokens of ordinary length: whole classes of frequency from the top, as
    long as they are no more than HEAD_PIECES together. The classes are some hundred numbers."""
    short = lengths.where(F.octet_length("piece") <= HEAD_BYTES)
    level = F.floor(F.log2("times") * 8)
    levels = short.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    total, least = 0, None
    for row in levels:
        total += row["count"]
        if total > HEAD_PIECES:
            break
        least = row["level"]
    if least is None:
        return short.where(F.lit(False))
    return short.where(level >= least)


def count_tokens(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row (id, n_bytes, n_tokens) for each row of ``docs``; ``tokenizer`` is a file's text.

    Counts are those of the tokenizers library without begin, end or added special tokens: a special
    string inside a text counts as one token. Null and empty texts have 0 bytes and 0 tokens. Null
    ids and repeated rows are kept: each row counts for itself. Other columns of ``docs`` are not
    read. Texts of any length are whole: a text's pre-tokens are gathered as frequencies, in rows of
    at most ROW_PIECES.

    The frequencies are stored once. The most frequent pre-tokens (a bounded table) are joined by
    broadcast, so hot words are never shuffled; the rest by their string.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col)
    )
    kind = dict(rows.dtypes)["id"]
    fields = f"row long, id {kind}, n_bytes long, pieces array<struct<piece: string, times: long>>"
    table = spark.createDataFrame([], fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    run = _frequencies(special_strings(tokenizer), to_arrow_schema(table.schema))
    with arrow_bytes(spark, BATCH_BYTES):
        counted = stored(rows.mapInArrow(run, table.schema), "pre-tokens", codec="zstd")
        pieces = counted.select("row", F.inline("pieces"))
        distinct = pieces.groupBy("piece").agg(F.sum("times").alias("times"))
        shipped = spark.sparkContext.broadcast(tokenizer)
        lengths = stored(
            distinct.mapInArrow(_lengths(shipped), "piece string, times long, n long"), "pieces"
        )
    head = _head(lengths).select("piece", "n")
    summed = F.sum(F.col("times") * F.col("n")).alias("n_tokens")
    hot = pieces.join(F.broadcast(head), "piece").groupBy("row").agg(summed)
    rest = pieces.join(F.broadcast(head.select("piece")), "piece", "left_anti")
    cold = rest.join(lengths.select("piece", "n"), "piece").groupBy("row").agg(summed)
    none = F.lit(0).cast("long")
    parts = counted.select("row", "id", "n_bytes", none.alias("n_tokens"))
    for part in (hot, cold):
        part = part.select("row", F.lit(None).cast(kind).alias("id"), none.alias("n_bytes"), "n_tokens")
        parts = parts.unionByName(part)
    total = parts.groupBy("row").agg(
        F.max("id").alias("id"),
        F.sum("n_bytes").alias("n_bytes"),
        F.sum("n_tokens").alias("n_tokens"),
    )
    return total.select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
