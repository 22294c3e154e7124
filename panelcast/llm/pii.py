"""Personal data: fixed kinds by pattern, and terms that disclose them by corpus co-occurrence.

An entity is a distinct value of one of the fixed kinds. A term (a word of letters) that stands
near an entity's occurrences and hardly anywhere else reveals the entity. How strongly is measured
as the share of the entity's information that the term gives away:

    disclosure(t, e) = log2(p(e | t) / p(e)) / log2(1 / p(e)),

where p(e) is the share of all documents that hold e, and p(e | t) the share of the documents with
t that have e near it. It is 1 when t never occurs without e, and 0 when they are independent.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import row_key, stored
from panelcast.session import ship_package

#: The kinds in the order in which spans of equal start are listed; the method adds ``term``.
KINDS = ("email", "ip", "card", "phone", "term")
#: Words on either side of an entity that count as near it, and shortest term, in letters.
REACH, SHORTEST = 8, 4
#: Different texts that must show a term near the entity; disclosure from which a term is
#: generalised, and from which it is removed.
MIN_TEXTS, GENERALISE, REMOVE = 3, 0.9, 0.97
#: Bits of the candidate filter that is broadcast to the scans: 512 KiB.
FILTER_BITS = 1 << 22

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Runs of digits are taken whole and never given back, so that no text takes quadratic time.
_NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++){0,3}+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{%d,}" % SHORTEST)

_Batches = Iterator[pa.RecordBatch]
Span = tuple[int, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            low = domain.end()
            yield start, low
        at = text.find("@", max(at + 1, low))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) in code points, by start and then kind."""
    spans = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        for m in _NUMBERS.finditer(text):
            parts = m[0].split(".")
            if len(parts) == 4 and all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in parts):
                spans.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() < 12:
                continue
            digits = "".join(_DIGITS.findall(m[0]))
            if 12 <= len(digits) <= 19 and _luhn(digits):
                spans.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                    spans.append((3, m.start(), m.end()))
    return sorted(spans, key=lambda s: (s[1], s[0]))


def _entity(kind: int, value: str) -> int:
    plain = value.lower() if kind == 0 else value if kind == 1 else "".join(_DIGITS.findall(value))
    digest = hashlib.blake2b(f"{kind}:{plain}".encode(), digest_size=8).digest()
    return int.from_bytes(digest, "big", signed=True)


def contexts(text: str, spans: list[Span], reach: int = REACH) -> set[tuple[str, int]]:
    """(term, entity) of all terms within ``reach`` terms of a span; terms inside spans don't count."""
    if not spans:
        return set()
    terms = [
        (m.start(), m.end(), m[0].lower())
        for m in _TERM.finditer(text)
        if not any(a < m.end() and m.start() < b for _, a, b in _near(spans, m.start(), m.end()))
    ]
    starts, found = [t[0] for t in terms], set()
    for kind, a, b in spans:
        entity, low = _entity(kind, text[a:b]), bisect_left(starts, a)
        high = bisect_right(starts, b - 1)
        for _, _, term in terms[max(0, low - reach) : low] + terms[high : high + reach]:
            found.add((term, entity))
    return found


def _near(spans: list[Span], start: int, end: int) -> list[Span]:
    """The spans that may overlap [start, end): spans are ordered, and few begin together."""
    at = bisect_left(spans, end, key=lambda s: s[1])
    return spans[max(0, at - 2 * len(KINDS)) : at]


_SPANS = "array<struct<kind:int,start:int,end:int>>"
_SPAN_TYPE = pa.list_(
    pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
)
_PAIR_TYPE = pa.list_(pa.struct([("term", pa.string()), ("entity", pa.int64())]))
_ROW_TYPE = pa.list_(
    pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
)


def _scan(reach: int, batches: _Batches) -> _Batches:
    """(id, k1, k2, text's hash, text) to (id, k1, k2, text's hash, spans, pairs)."""
    for batch in batches:
        spans_out, pairs_out = [], []
        for text in batch.column(4).to_pylist():
            spans = base_spans(text) if text else []
            spans_out.append([dict(zip(("kind", "start", "end"), s)) for s in spans])
            pairs_out.append([{"term": t, "entity": e} for t, e in sorted(contexts(text or "", spans, reach))])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array(spans_out, _SPAN_TYPE), pa.array(pairs_out, _PAIR_TYPE)],
            ["_id", "_k1", "_k2", "_text", "spans", "pairs"],
        )


def _maybe(bits: np.ndarray, term: str) -> bool:
    code = zlib.crc32(term.encode()) % FILTER_BITS
    return bool(bits[code >> 3] >> (code & 7) & 1)


def _count(bits, batches: _Batches) -> _Batches:
    """Documents that hold each candidate term, summed per task in portions of bounded size."""
    table, seen = bits.value, Counter()

    def flush():
        part = pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"]
        )
        seen.clear()
        return part

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                seen.update(t for t in {w.lower() for w in _TERM.findall(text)} if _maybe(table, t))
            if len(seen) > 100_000:
                yield flush()
    yield flush()


def _occurrences(bits, batches: _Batches) -> _Batches:
    table = bits.value
    for batch in batches:
        rows = []
        for text in batch.column(2).to_pylist():
            found = []
            for m in _TERM.finditer(text or ""):
                term = m[0].lower()
                if _maybe(table, term):
                    found.append({"term": term, "start": m.start(), "end": m.end()})
            rows.append(found)
        keep = pa.array([bool(r) for r in rows])
        out = pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(rows, _ROW_TYPE)], ["_k1", "_k2", "found"]
        )
        yield out.filter(keep)


def _filter_bits(terms: DataFrame) -> np.ndarray:
    """Bitmap of the terms' CRCs; what reaches the driver is bounded by its fixed size."""
    code = F.crc32(F.col("term").cast("binary")) % FILTER_BITS
    rows = (
        terms.select(code.alias("_c"))
        .groupBy(F.expr("_c div 32").alias("_word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(_c % 32 as int)))").alias("_bits"))
    )
    words = np.zeros(FILTER_BITS // 32, np.uint32)
    for word, bits in rows.collect():
        words[word] = bits
    return words.view(np.uint8)


def disclosing_terms(
    docs: DataFrame,
    scanned: DataFrame,
    text_col: str = "text",
    min_texts: int = MIN_TEXTS,
    generalise: float = GENERALISE,
    remove: float = REMOVE,
) -> DataFrame:
    """(term, disclosure, action) of the terms whose disclosure reaches ``generalise``.

    A term needs ``min_texts`` different texts near one entity, so copies of one text are no
    evidence. Probabilities count documents over the whole corpus.
    """
    pairs = scanned.select("_k1", "_k2", "_text", F.explode("pairs").alias("p"))
    pairs = pairs.select("_k1", "_k2", "_text", "p.term", "p.entity")
    near = (
        pairs.groupBy("term", "entity", "_text")
        .agg(F.count("*").alias("n"))
        .groupBy("term", "entity")
        .agg(F.count("*").alias("texts"), F.sum("n").alias("near"))
        .where(F.col("texts") >= min_texts)
    )
    near = stored(near, "pii-near")
    candidates = stored(near.select("term").distinct(), "pii-candidates")
    bits = docs.sparkSession.sparkContext.broadcast(_filter_bits(candidates))
    totals = (
        docs.select(text_col)
        .mapInArrow(partial(_count, bits), "term string, n long")
        .groupBy("term")
        .agg(F.sum("n").alias("with_term"))
    )
    entities = (
        pairs.select("entity", "_k1", "_k2").distinct().groupBy("entity").agg(F.count("*").alias("holds"))
    )
    n = scanned.count()
    share = F.col("holds") / F.lit(max(n, 1))
    ratio = F.log2(F.col("near") / F.col("with_term") / share) / F.log2(1 / share)
    # where every document holds the entity there is nothing to reveal: log2(1 / share) is 0
    scored = near.join(totals, "term").join(entities, "entity").where(share < 1)
    best = scored.groupBy("term").agg(F.least(F.lit(1.0), F.max(ratio)).alias("disclosure"))
    action = F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise")
    return best.where(F.col("disclosure") >= generalise).withColumn("action", action)


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, _k1, _k2, base (spans of the fixed kinds) and terms (spans
    of disclosing terms outside them, with the action). Spans count code points, end exclusive.

    Null texts count as empty. Rows that repeat id and text get equal spans. An empty table gives
    an empty result; other columns are ignored."""
    ship_package(docs.sparkSession)
    keyed = docs.select(
        F.col(id_col).alias("_id"),
        *row_key(id_col, text_col),
        F.xxhash64(text_col).alias("_text"),
        F.col(text_col).alias("_t"),
    )
    kind = docs.schema[id_col].dataType.simpleString()
    scanned = stored(
        keyed.mapInArrow(
            partial(_scan, REACH),
            f"_id {kind}, _k1 long, _k2 long, _text long, spans {_SPANS}, "
            "pairs array<struct<term:string,entity:long>>",
        ),
        "pii-spans",
    )
    flagged = stored(disclosing_terms(docs, scanned, text_col), "pii-terms")
    bits = docs.sparkSession.sparkContext.broadcast(_filter_bits(flagged))
    found = keyed.select("_k1", "_k2", "_t").mapInArrow(
        partial(_occurrences, bits),
        "_k1 long, _k2 long, found array<struct<term:string,start:int,end:int>>",
    )
    hits = (
        found.select("_k1", "_k2", F.explode("found").alias("f"))
        .select("_k1", "_k2", "f.term", "f.start", "f.end")
        .distinct()
        .join(flagged.select("term", "action"), "term")
        .groupBy("_k1", "_k2")
        .agg(F.collect_list(F.struct("start", "end", "action")).alias("_terms"))
    )
    joined = scanned.join(hits, ["_k1", "_k2"], "left")
    clear = F.filter(
        F.array_sort("_terms"),
        lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])),
    )
    empty = F.array().cast("array<struct<start:int,end:int,action:string>>")
    return joined.select(
        F.col("_id").alias(id_col),
        "_k1",
        "_k2",
        F.col("spans").alias("base"),
        F.coalesce(clear, empty).alias("terms"),
    )


def count_of(spans: Column, kind: str) -> Column:
    """How many of the spans are of a kind."""
    # a second parameter of the lambda, default or not, would be the index in the array
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def span_list(base: Column, terms: Column | None = None) -> Column:
    """``kind:start:end`` of all spans by start, then kind, joined by commas."""
    parts = base
    if terms is not None:
        added = F.transform(
            terms,
            lambda t: F.struct(
                F.lit(len(KINDS) - 1).alias("kind"), t["start"].alias("start"), t["end"].alias("end")
            ),
        )
        parts = F.concat(base, added)
    ordered = F.array_sort(
        F.transform(parts, lambda s: F.struct(s["start"].alias("a"), s["kind"].alias("k"), s["end"].alias("b")))
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            ordered,
            lambda s: F.concat_ws(":", F.get(names, s["k"]), s["a"].cast("string"), s["b"].cast("string")),
        ),
        ",",
    )


def _rewrite(batches: _Batches) -> _Batches:
    marks = [f"[{k.upper()}]" for k in KINDS]
    for batch in batches:
        out = []
        for text, base, terms in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
            spans = [(s["start"], s["end"], marks[s["kind"]]) for s in base]
            spans += [(t["start"], t["end"], "" if t["action"] == "remove" else marks[-1]) for t in terms]
            parts, at = [], 0
            for start, end, mark in sorted(spans):
                if start >= at:
                    parts += [(text or "")[at:start], mark]
                at = max(at, end)
            out.append("".join([*parts, (text or "")[at:]]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(out, pa.string())], ["_k1", "_k2", "sanitised"]
        )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sanitised): values of the fixed kinds and generalised terms become marks like
    ``[EMAIL]`` and ``[TERM]``; terms of the highest disclosure are taken out. One row per distinct
    row of id and text."""
    spans = find_spans(docs, id_col, text_col).dropDuplicates(["_k1", "_k2"])
    keyed = docs.select(F.col(id_col), *row_key(id_col, text_col), F.col(text_col).alias("_t"))
    keyed = keyed.dropDuplicates(["_k1", "_k2"])
    rows = keyed.join(spans.drop(id_col), ["_k1", "_k2"])
    text = rows.select("_k1", "_k2", "_t", "base", "terms").mapInArrow(
        _rewrite, "_k1 long, _k2 long, sanitised string"
    )
    return keyed.select(id_col, "_k1", "_k2").join(text, ["_k1", "_k2"]).select(id_col, "sanitised")
