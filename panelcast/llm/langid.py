"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads segments of ``SEGMENT`` bytes in both directions, gives every byte a probability
per language, and a document gets the mean over all its bytes. Segments keep the steps of one pass
bounded for texts of any length, and thousands of them advance together as one matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from panelcast.llm.common import arrow_bytes, drop_rows, row_key, stored, text_of
from panelcast.llm.words import text_blocks
from panelcast.session import ship_package

#: Bytes of a segment, units per direction, segments that advance together.
SEGMENT, UNITS, LANES = 128, 8, 2048
#: The training sample: labelled documents per language, and segments of each, spread evenly.
SAMPLE_DOCS, SAMPLE_SEGMENTS = 400, 3
#: Languages learned, the most frequent ones; it bounds the sample together with the above.
MAX_LANGUAGES = 200
UNKNOWN = "und"
#: Bytes of texts that are handed to Python at once.
BATCH_BYTES = 1 << 20

#: A letter: Unicode class L, which no digit, fraction or numeral sign belongs to.
_LETTER = regex.compile(r"\p{L}")
_Batches = Iterator[pa.RecordBatch]


@dataclass
class Network:
    """Weights per direction: inputs (256, 3h), recurrent (h, 3h), bias of the candidate (h).
    Gates are update and reset, stored halved, so that a sigmoid is ``0.5 * tanh(x) + 0.5``."""

    languages: list[str]
    inputs: list[np.ndarray] = field(default_factory=list)
    recurrent: list[np.ndarray] = field(default_factory=list)
    output: np.ndarray | None = None
    bias: np.ndarray | None = None


def _step(x, h, recurrent, units):
    """One gated step of all lanes; x holds the inputs' part and is overwritten."""
    g = h @ recurrent
    x[:, : 2 * units] += g[:, : 2 * units]
    gates = np.tanh(x[:, : 2 * units])
    gates *= 0.5
    gates += 0.5
    inner = g[:, 2 * units :]
    new = gates[:, units:] * inner
    new += x[:, 2 * units :]
    np.tanh(new, out=new)
    return gates, inner, new


def _run(net: Network, way: int, codes: np.ndarray, mask: np.ndarray | None, keep: list | None):
    """States (steps, lanes, h) of one direction. ``mask`` (steps, lanes) holds a lane's state at
    zero behind its end, which matters to the backward direction only."""
    steps, lanes = codes.shape
    units = net.recurrent[way].shape[0]
    states = np.empty((steps, lanes, units), np.float32)
    h = np.zeros((lanes, units), np.float32)
    for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
        x = net.inputs[way].take(codes[t], axis=0)
        gates, inner, new = _step(x, h, net.recurrent[way], units)
        if keep is not None:
            keep.append((t, h, gates, inner, new))
            new = new.copy()
        new -= h
        new *= gates[:, :units]
        h = h + new
        if mask is not None:
            h *= mask[t][:, None]
        states[t] = h
    return states


def _probabilities(net: Network, codes: np.ndarray, mask: np.ndarray, keeps=None):
    ahead = _run(net, 0, codes, None, keeps and keeps[0])
    back = _run(net, 1, codes, mask, keeps and keeps[1])
    scores = ahead @ net.output[: ahead.shape[2]]
    scores += back @ net.output[ahead.shape[2] :]
    scores += net.bias
    scores -= scores.max(axis=2, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=2, keepdims=True)
    return scores, ahead, back


def train(
    segments: list[bytes],
    labels: list[int],
    languages: list[str],
    units: int = UNITS,
    epochs: int = 6,
    rate: float = 0.02,
    batch: int = 128,
    seed: int = 7,
) -> Network:
    """Fit by backpropagation through time with Adam; every byte carries its document's label."""
    rng = np.random.default_rng(seed)
    k = len(languages)

    def start(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    net = Network(
        languages,
        [start(256, 3 * units, scale=0.3) for _ in range(2)],
        [start(units, 3 * units, scale=units**-0.5) for _ in range(2)],
        start(2 * units, k, scale=0.3),
        np.zeros(k, np.float32),
    )
    params = [*net.inputs, *net.recurrent, net.output, net.bias]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    codes = np.zeros((SEGMENT, len(segments)), np.uint8)
    mask = np.zeros((SEGMENT, len(segments)), np.float32)
    for i, s in enumerate(segments):
        codes[: len(s), i] = np.frombuffer(s, np.uint8)
        mask[: len(s), i] = 1
    labels, turn = np.array(labels), 0
    for _ in range(epochs):
        mixed = rng.permutation(len(segments))
        for low in range(0, len(segments), batch):
            pick = mixed[low : low + batch]
            grads = _gradients(net, codes[:, pick], mask[:, pick], labels[pick])
            turn += 1
            for p, g, m, v in zip(params, grads, first, second):
                np.clip(g, -1, 1, out=g)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-7)
    return net


def _gradients(net, codes, mask, labels):
    keeps: tuple[list, list] = ([], [])
    probs, ahead, back = _probabilities(net, codes, mask, keeps)
    steps, lanes, k = probs.shape
    probs[:, np.arange(lanes), labels] -= 1
    probs *= (mask / mask.sum())[:, :, None]
    flat = probs.reshape(-1, k)
    units = ahead.shape[2]
    both = np.concatenate([ahead, back], axis=2).reshape(-1, 2 * units)
    back_in = (flat @ net.output.T).reshape(steps, lanes, 2 * units)
    inputs, recurrents = [], []
    for way in range(2):
        gin, grec = np.zeros_like(net.inputs[way]), np.zeros_like(net.recurrent[way])
        dh = np.zeros((lanes, units), np.float32)
        for t, h, gates, inner, new in reversed(keeps[way]):
            dh += back_in[t, :, way * units : (way + 1) * units]
            if way == 1:
                dh *= mask[t][:, None]
            z, r = gates[:, :units], gates[:, units:]
            dn = dh * z * (1 - new * new)
            # gates are halved inside: d sigmoid / d stored = 2 s (1 - s)
            dz = dh * (new - h) * 2 * z * (1 - z)
            dr = dn * inner * 2 * r * (1 - r)
            dx = np.concatenate([dz, dr, dn], axis=1)
            dg = np.concatenate([dz, dr, dn * r], axis=1)
            np.add.at(gin, codes[t], dx)
            grec += h.T @ dg
            dh = dh * (1 - z) + dg @ net.recurrent[way].T
        inputs.append(gin)
        recurrents.append(grec)
    return [*inputs, *recurrents, both.T @ flat, flat.sum(axis=0)]


def document_probabilities(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, languages): mean of the bytes' probabilities; empty texts get zeros."""
    lengths = np.diff(offsets)
    parts = -(-lengths // SEGMENT)
    owner = np.repeat(np.arange(len(lengths)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = offsets[:-1][owner] + nth * SEGMENT
    size = np.minimum(SEGMENT, lengths[owner] - nth * SEGMENT)
    total = np.zeros((len(lengths), len(net.languages)))
    padded = np.append(data, np.zeros(SEGMENT, np.uint8))
    order = np.argsort(-size, kind="stable")
    clock = np.arange(SEGMENT)
    for low in range(0, len(order), LANES):
        lanes = order[low : low + LANES]
        steps = clock[: size[lanes[0]], None]
        codes = padded[begin[lanes][None, :] + steps]
        mask = (steps < size[lanes][None, :]).astype(np.float32)
        full = size[lanes[-1]] == len(steps)
        probs, _, _ = _probabilities(net, codes, None if full else mask)
        pooled = probs.sum(axis=0) if full else np.einsum("tlk,tl->lk", probs, mask)
        np.add.at(total, owner[lanes], pooled)
    return total / np.maximum(lengths, 1)[:, None]


def _label(net: Network, text_at: int, batches: _Batches) -> _Batches:
    names = np.array([*net.languages, UNKNOWN], object)
    for batch in batches:
        column = batch.column(text_at)
        best, score = [], []
        for first, end, data, offsets in text_blocks(column):
            if net.languages:
                probs = document_probabilities(net, data, offsets)
                pick, sure = probs.argmax(axis=1), probs.max(axis=1)
            else:
                pick, sure = np.zeros(end - first, int), np.zeros(end - first)
            letters = [t is not None and _LETTER.search(t) is not None for t in column[first : end].to_pylist()]
            pick = np.where(letters, pick, len(net.languages))
            best.append(names[pick])
            score.append(np.where(letters, np.clip(sure, 0, 1), 0.0))
        lang = pa.array(np.concatenate(best) if best else [], pa.string())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, lang, pa.array(np.concatenate(score) if score else [], pa.float64())],
            [*batch.schema.names, "lang_pred", "score"],
        )


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Network:
    """Train on a bounded sample of the labelled rows: of each of the ``MAX_LANGUAGES`` most
    frequent languages, the ``SAMPLE_DOCS`` texts that come first by hash, and of each text
    ``SAMPLE_SEGMENTS`` segments spread evenly over its length. Rows without text or label are
    left out. Repeated texts count once."""
    usable = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("_lang"), F.xxhash64(text_col).alias("_h"), F.col(text_col).alias("_t")
    )
    texts = usable.groupBy("_lang", "_h").count().groupBy("_lang")
    counts = texts.agg(F.sum("count").alias("rows"), F.count("*").alias("texts"))
    counts = counts.orderBy(F.desc("rows"), "_lang").limit(MAX_LANGUAGES)
    counts = {r["_lang"]: r["texts"] for r in counts.collect()}
    if not counts:
        return Network([])
    size = F.octet_length("_t")
    segments = F.transform(
        F.sequence(F.lit(0), F.lit(SAMPLE_SEGMENTS - 1)),
        lambda i: F.substring(
            F.col("_t").cast("binary"),
            (F.greatest(F.lit(0), size - SEGMENT) * i / max(1, SAMPLE_SEGMENTS - 1)).cast("int") + 1,
            F.lit(SEGMENT),
        ),
    )
    # Some four times as many texts as needed go on by their hash; the window then holds only those.
    # The share is one of distinct texts, so that copies don't thin it out.
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, 4 * SAMPLE_DOCS / n)])
    near = usable.where(F.pmod("_h", F.lit(1 << 40)) / (1 << 40) < share[F.col("_lang")])
    near = near.select("_lang", "_h", segments.alias("_s")).dropDuplicates(["_lang", "_h"])
    nth = F.row_number().over(Window.partitionBy("_lang").orderBy(F.pmod("_h", F.lit(1 << 40)), "_h"))
    rows = near.withColumn("_nth", nth).where(F.col("_nth") <= SAMPLE_DOCS).collect()
    # a language of empty texts only has nothing to learn from
    languages = sorted({row["_lang"] for row in rows if any(row["_s"])})
    gathered, labels = [], []
    for row in sorted(rows, key=lambda r: (r["_lang"], r["_nth"])):
        for s in sorted({bytes(s) for s in row["_s"]} - {b""}):
            gathered.append(s)
            labels.append(languages.index(row["_lang"]))
    if not gathered:
        return Network([])
    return train(gathered, labels, languages)


def held_out(id_col: str, folds: int) -> Column:
    """Is crc32 of the id as text divisible by ``folds``? False for a null id."""
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    return F.coalesce(crc % folds == 0, F.lit(False))


def label_documents(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced. Null texts
    and texts without a letter are ``und`` with score 0; a network without languages says ``und``
    always. Rows are handled one by one, so repeated rows get the same answer."""
    ship_package(docs.sparkSession)
    rows = docs.drop("lang_pred", "score")
    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    schema = StructType([*rows.schema.fields, *added])
    if not net.languages:
        unknown = rows.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
        return unknown
    return rows.mapInArrow(partial(_label, net, rows.columns.index(text_col)), schema)


def drop_unrecognised(docs: DataFrame, net: Network, margin: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in a language that the network knows, with all their columns.

    Rows without a letter go, and those whose best language is hardly better than chance: a score
    below 1/K + margin * (1 - 1/K) with K languages. If nothing could be learned, all rows with a
    letter stay. Only keys and texts are handed to Python, and only keys of rows that go come back.
    """
    chance = 1.0 / max(1, len(net.languages))
    least = chance + margin * (1.0 - chance)
    rows = docs.select(*row_key(text_col=text_col), F.col(text_col).alias("_text"))
    if net.languages:
        found = label_documents(rows, net, "_text")
        gone = (F.col("lang_pred") == UNKNOWN) | (F.col("score") < least)
    else:
        found, gone = rows, ~F.regexp_like(text_of("_text"), F.lit(r"\p{L}"))
    with arrow_bytes(docs.sparkSession, BATCH_BYTES):
        dropped = stored(found.where(gone).select("_k1", "_k2"), "unrecognised")
    return drop_rows(docs, dropped, text_col=text_col)
