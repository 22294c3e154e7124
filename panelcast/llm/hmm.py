"""LM scoring with a hidden Markov model over words.

Every word has emissions of its own, from the expected counts n(w, state) that Baum-Welch gathers.
How a word splits over the states is smoothed by the split of all tokens, with the weight of
``PRIOR`` tokens per word, so that rare words stay near the corpus:

    P(w | state) = p0(w) * P(state | w) / z(state)
    P(state | w) = (n(w, state) + PRIOR * n(state) / N) / (c(w) + PRIOR)
    p0(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)), with one slot for all unknown words

z sums the numerators, so every state's word probabilities sum to one. Baum-Welch runs over all training tokens. Expected
counts are summed per (word, state) and grow with the vocabulary, so they stay distributed: a block
of text sends its words' counts to the buckets of words, and gets the sums of its own words back.
Only starts, moves, sizes and sums z of states, which are of fixed size, come to the driver.

Texts are cut into blocks of some megabytes with a vocabulary of their own. Only (block, word) rows,
packed by bucket, are shuffled to count words and to hand counts back, never a row per token; a
frequent word has one row per block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import arrow_bytes, discard, stored
from panelcast.llm.words import text_blocks
from panelcast.session import ship_package

#: Hash classes of words in the random start (0 is the end of a text), latent states, rounds of
#: Baum-Welch. Words of a class start alike and then learn apart.
SYMBOLS, STATES, ROUNDS = 1 << 15, 6, 5
#: Bytes of text in a block; tokens of a training segment. A large block names its words less often.
BLOCK_BYTES, SEGMENT = 16 << 20, 256
#: Bytes that are handed to Python at once, or one block. A worker and the JVM beside its heap hold a few
#: times as much; a block is gathered over many batches.
BATCH_BYTES = 1 << 20
#: A word's id is its bucket, shifted by so many bits, and its place in the bucket.
PLACE_BITS = 33
#: Smoothing of counts, and weight of the corpus in the split of a word over states, in tokens.
ADD, PRIOR = 0.1, 5.0
#: Compression of the blocks' token numbers, which are small for frequent words.
CODEC = "zstd"
END = b""

_Batches = Iterator[pa.RecordBatch]
_BLOCK = (
    "ids array<long>, held array<boolean>, sizes array<int>, tokens binary, "
    "words array<binary>, counts array<long>"
)


_GOT = "array<struct<bucket:int,n:int,sums:binary>>"

#: Expected counts travel as shares of a word's count: whole numbers of so many parts, in 16 bits, of
#: all states but the last, whose share is the rest.
PARTS = (1 << 16) - 1


@dataclass
class Model:
    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray  # (words, states)


@dataclass
class Shared:
    """What is the same for all words: starts and moves, share of the tokens and sum z of each
    state, size of the corpus. ``first`` has the random start by hash class until the first round
    has counted."""

    start: np.ndarray
    moves: np.ndarray
    share: np.ndarray
    z: np.ndarray
    total: int
    kinds: int
    first: np.ndarray | None = None

    def base(self, known: np.ndarray) -> np.ndarray:
        return (known + ADD) / (self.total + ADD * (self.kinds + 1))


# --- blocks ----------------------------------------------------------------------------------


class _Block:
    """Rows on their way into a block: what stays of a text is its token numbers."""

    def __init__(self):
        self.ids, self.held, self.parts, self.bytes = [], [], [], 0
        self.seen: dict[bytes, int] = defaultdict()
        self.seen.default_factory = self.seen.__len__
        self.seen[END]

    def add(self, ids: list, held: list, data: np.ndarray, offsets: np.ndarray) -> None:
        look, raw = self.seen.__getitem__, data.tobytes()
        for a, b in zip(offsets[:-1], offsets[1:]):
            words = raw[a:b].lower().split()
            words.append(END)
            self.parts.append(np.fromiter(map(look, words), np.int32, len(words)))
        self.ids += ids
        self.held += map(bool, held)
        self.bytes += len(raw)

    def batch(self) -> pa.RecordBatch:
        sizes = np.array([len(p) for p in self.parts])
        tokens, seen = np.concatenate(self.parts), self.seen
        self.parts.clear()
        counts = np.bincount(tokens[np.repeat(~np.array(self.held), sizes)], minlength=len(seen))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([self.ids], pa.list_(pa.int64())),
                pa.array([self.held], pa.list_(pa.bool_())),
                pa.array([sizes], pa.list_(pa.int32())),
                pa.array([pa.compress(pa.py_buffer(tokens), CODEC, asbytes=True)], pa.binary()),
                pa.array([list(seen)], pa.list_(pa.binary())),
                pa.array([counts], pa.list_(pa.int64())),
            ],
            ["ids", "held", "sizes", "tokens", "words", "counts"],
        )


def _blocks(batches: _Batches) -> _Batches:
    block = _Block()
    for batch in batches:
        for first, end, data, offsets in text_blocks(batch.column(2), min(BATCH_BYTES, BLOCK_BYTES)):
            if block.parts and block.bytes + len(data) > BLOCK_BYTES:
                yield block.batch()
                block = _Block()
            ids, held = (batch.column(i).slice(first, end - first).to_pylist() for i in (0, 1))
            block.add(ids, held, data, offsets)
    if block.parts:
        yield block.batch()


def _tokens(packed: pa.BinaryScalar, sizes: np.ndarray) -> np.ndarray:
    raw = pa.decompress(packed.as_buffer(), int(sizes.sum()) * 4, CODEC)
    return np.frombuffer(raw, np.int32)


def word_counts(blocks: DataFrame) -> DataFrame:
    """(word, c, symbol, id) of the training tokens; the empty word is the end of a text. Words of a
    partition are a bucket, so that Spark's bound on partitions is one on buckets."""
    rows = blocks.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).where("x.counts > 0")
    counts = rows.groupBy(F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("c"))
    symbol = F.when(F.length("word") == 0, F.lit(0)).otherwise(
        F.crc32("word") % (SYMBOLS - 1) + 1
    )
    ids = F.monotonically_increasing_id()
    return stored(counts.withColumns({"symbol": symbol.cast("int"), "id": ids}), "word-counts")


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), CODEC, asbytes=True)


def _unpacked(packed: pa.BinaryScalar, n: int, kind) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    raw = pa.decompress(packed.as_buffer(), n * np.dtype(kind).itemsize, CODEC)
    return np.frombuffer(raw, kind)


def _pack(batches: _Batches) -> _Batches:
    """The known words of each block, packed: id (as steps, which are small), place in the block and
    count in ``known``, hash class in ``symbols``."""
    for batch in batches:
        at = {name: batch.schema.get_field_index(name) for name in ("id", "at", "c", "symbol")}
        kept = [i for i in range(batch.num_columns) if i not in at.values()]
        for row in range(batch.num_rows):
            ids, places, counts, symbols = (
                v.values.to_numpy(zero_copy_only=False) if v.is_valid else np.zeros(0, np.int64)
                for v in (batch.column(i)[row] for i in at.values())
            )
            parts = [np.diff(ids, prepend=0), places.astype(np.int32), counts.astype(np.int64)]
            known = _packed(np.frombuffer(b"".join(p.tobytes() for p in parts), np.uint8))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i).slice(row, 1) for i in kept),
                    pa.array([len(ids)], pa.int32()),
                    pa.array([known], pa.binary()),
                    pa.array([_packed(symbols.astype(np.int16))], pa.binary()),
                ],
                [*(batch.schema.names[i] for i in kept), "n_known", "known", "symbols"],
            )


def _placed(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """The blocks with place, id, count and symbol of their known words in order of id."""
    found = (
        blocks.select("block", F.posexplode("words").alias("at", "word"))
        .join(counts, "word")
        .groupBy("block")
        .agg(F.sort_array(F.collect_list(F.struct("id", "at", "c", "symbol"))).alias("_x"))
    )
    # stored on its own, so that the shuffles of the two joins are not on disk together
    found = stored(found, "known-words", codec="zstd")
    kept = blocks.select("block", "ids", "held", "sizes", "tokens", F.size("words").alias("n_words"))
    known = [F.col(f"_x.{c}").alias(c) for c in ("id", "at", "c", "symbol")]
    joined = kept.join(found, "block", "left").select(*kept.columns, *known)
    packed = joined.mapInArrow(
        _pack,
        "block long, ids array<long>, held array<boolean>, sizes array<int>, tokens binary, "
        "n_words int, n_known int, known binary, symbols binary",
    )
    placed = stored(packed, "placed")
    discard(found)
    return placed


# --- recursions ------------------------------------------------------------------------------


def _lanes(codes: np.ndarray, begins: np.ndarray, sizes: np.ndarray):
    """Sequences side by side, longest first: their order, how many are alive at each step, where
    each step's codes start, and the codes of step after step."""
    order = np.argsort(-sizes, kind="stable")
    steps = int(sizes[order[0]]) if len(order) else 0
    alive = np.searchsorted(-sizes[order], -np.arange(steps), "left")
    offsets = np.append(0, np.cumsum(alive))
    size = sizes[order]
    rank = np.repeat(np.arange(len(order)), size)
    step = np.arange(len(rank)) - np.repeat(np.cumsum(size) - size, size)
    by_step = np.empty(len(rank), codes.dtype)
    by_step[offsets[step] + rank] = codes[np.repeat(begins[order], size) + step]
    return order, alive, offsets, by_step


def log_likelihoods(model: Model, codes: np.ndarray, begins, sizes) -> np.ndarray:
    """Natural logarithm of each sequence's probability by the scaled forward recursion."""
    order, alive, offsets, by_step = _lanes(codes, begins, sizes)
    scales = np.empty(len(by_step))
    ones = np.ones(len(model.start))
    state = None
    for t, n in enumerate(alive):
        now = model.emits.take(by_step[offsets[t] : offsets[t + 1]], axis=0)
        now *= model.start if state is None else state[:n] @ model.moves
        scale = scales[offsets[t] : offsets[t + 1]]
        np.dot(now, ones, out=scale)
        now /= scale[:, None]
        state = now
    rank = np.arange(len(by_step)) - np.repeat(offsets[:-1], alive)
    out = np.empty(len(sizes))
    out[order] = np.bincount(rank, np.log(scales), len(sizes))
    return out


def expected_counts(model: Model, codes: np.ndarray, begins, sizes):
    """Baum-Welch: expected starts, moves and emissions of all sequences, and their likelihood."""
    _, alive, offsets, by_step = _lanes(codes, begins, sizes)
    k, kind = len(model.start), model.emits.dtype
    emitted = model.emits.take(by_step, axis=0)
    ahead, scales = np.empty_like(emitted), np.empty(len(by_step), kind)
    ones = np.ones(k, kind)
    for t, n in enumerate(alive):
        low, high = offsets[t], offsets[t + 1]
        now = ahead[low:high]
        if t:
            np.matmul(ahead[offsets[t - 1] : offsets[t - 1] + n], model.moves, out=now)
            now *= emitted[low:high]
        else:
            np.multiply(emitted[low:high], model.start, out=now)
        np.dot(now, ones, out=scales[low:high])
        now /= scales[low:high, None]
    moves = np.zeros((k, k), kind)
    back = np.ones((len(sizes), k), kind)
    for t in range(len(alive) - 1, 0, -1):
        n, low, high = alive[t], offsets[t], offsets[t + 1]
        part = emitted[low:high]
        part *= back[:n]
        part /= scales[low:high, None]
        moves += ahead[offsets[t - 1] : offsets[t - 1] + n].T @ part
        # the posterior takes the place of the forward variable, which is not needed again
        ahead[low:high] *= back[:n]
        np.matmul(part, model.moves.T, out=back[:n])
    first = ahead[: offsets[1]] if len(alive) else ahead
    first *= back
    emits = np.stack([np.bincount(by_step, ahead[:, i], len(model.emits)) for i in range(k)], axis=1)
    likelihood = float(np.log(scales).sum(dtype=np.float64))
    return first.sum(axis=0), moves * model.moves, emits, likelihood


# --- training --------------------------------------------------------------------------------


def _known(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, places and counts of a block's known words."""
    n = batch.column("n_known")[row].as_py()
    raw = _unpacked(batch.column("known")[row], 20 * n, np.uint8)
    ids = np.cumsum(raw[: 8 * n].view(np.int64))
    return ids, raw[8 * n : 12 * n].view(np.int32), raw[12 * n :].copy().view(np.int64)


def _emissions(shared: Shared, batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Training counts and emissions of a block's words."""
    k = len(shared.start)
    _, at, counts = _known(batch, row)
    known = np.zeros(batch.column("n_words")[row].as_py(), np.int64)
    known[at] = counts
    base = shared.base(known)[:, None]
    if shared.first is not None:
        symbols = _unpacked(batch.column("symbols")[row], len(at), np.int16)
        emits = base * shared.first[SYMBOLS]
        emits[at] = base[at] * shared.first[symbols]
        return known, emits
    emits = np.repeat(PRIOR * shared.share[None], len(base), axis=0)
    got = sorted(batch.column("got")[row].as_py() or [], key=lambda g: g["bucket"])
    if got:
        raw = (pa.decompress(g["sums"], 2 * (k - 1) * g["n"], CODEC, asbytes=True) for g in got)
        shares = np.frombuffer(b"".join(raw), np.uint16)
        emits[at] += counts[:, None] * _shares(shares, k)
    return known, base * emits / (known[:, None] + PRIOR) / shared.z


def _parts_of(counts: np.ndarray) -> np.ndarray:
    """Rows of counts -> shares of all columns but the last in whole parts."""
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1e-300)
    return np.rint(counts[:, :-1] / total * PARTS).clip(0, PARTS).astype(np.uint16)


def _shares(parts: np.ndarray, states: int) -> np.ndarray:
    out = np.empty((len(parts) // max(1, states - 1), states))
    out[:, :-1] = parts.reshape(-1, states - 1) / PARTS
    out[:, -1] = np.maximum(1.0 - out[:, :-1].sum(axis=1), 0.0)
    return out


def _segments(batch: pa.RecordBatch, row: int):
    sizes = np.array(batch.column("sizes")[row].as_py(), np.int64)
    held = np.array(batch.column("held")[row].as_py(), bool)
    codes = _tokens(batch.column("tokens")[row], sizes)
    begins = (np.cumsum(sizes) - sizes)[~held]
    own = np.bincount(codes[np.repeat(~held, sizes)], minlength=batch.column("n_words")[row].as_py())
    sizes = sizes[~held]
    parts = -(-sizes // SEGMENT)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    left = np.repeat(sizes, parts) - nth * SEGMENT
    return codes, np.repeat(begins, parts) + nth * SEGMENT, np.minimum(left, SEGMENT), own


#: Rows between blocks and buckets: sums that a block adds to a bucket, then its request for the
#: totals of the same places, and heads, which stand in bucket -1.
_COUNTS = "bucket int, asks boolean, block long, n int, places binary, sums binary"
_BACK = "block long, bucket int, n int, sums binary"


def _expect(model, batches: _Batches) -> _Batches:
    """Expected counts: of each block two rows per bucket of its words, and one head per task."""
    shared: Shared = model.value
    k = len(shared.start)
    head = np.zeros(k + k * k + 2 * k + 1)
    schema = pa.schema(
        [
            ("bucket", pa.int32()),
            ("asks", pa.bool_()),
            ("block", pa.int64()),
            ("n", pa.int32()),
            ("places", pa.binary()),
            ("sums", pa.binary()),
        ]
    )
    for batch in batches:
        for row in range(batch.num_rows):
            known, emits = _emissions(shared, batch, row)
            weights = shared.base(known) / (known + PRIOR)
            current = Model(*(v.astype(np.float32) for v in (shared.start, shared.moves, emits)))
            codes, begins, sizes, own = _segments(batch, row)
            counts = np.zeros(emits.shape)
            for low in range(0, len(sizes), 2048):
                part = expected_counts(current, codes, begins[low : low + 2048], sizes[low : low + 2048])
                counts += part[2]
                sizes_z = [part[2].sum(axis=0), weights @ part[2]]
                head += np.concatenate([part[0], part[1].ravel(), *sizes_z, [part[3]]])
            ids, at, _ = _known(batch, row)
            shares, own = _parts_of(counts[at]), own[at].astype(np.int32)
            buckets, cuts = np.unique(ids >> PLACE_BITS, return_index=True)
            places = (ids & ((1 << PLACE_BITS) - 1)).astype(np.int32)
            block = batch.column("block")[row].as_py()
            for bucket, a, b in zip(buckets.tolist(), cuts, [*cuts[1:], len(ids)]):
                mine = _packed(np.diff(places[a:b], prepend=np.int32(0)))
                sums = _packed(np.frombuffer(own[a:b].tobytes() + shares[a:b].tobytes(), np.uint8))
                columns = [[bucket] * 2, [False, True], [block] * 2, [int(b - a)] * 2, [mine] * 2, [sums, b""]]
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, columns)), schema)
    columns = [[-1], [False], [-1], [0], [b""], [head.tobytes()]]
    yield pa.RecordBatch.from_pydict(dict(zip(schema.names, columns)), schema)


def _add(states: int, batches: _Batches) -> _Batches:
    """Sum buckets over all blocks, and give each block the sums of its words back. Rows come sorted
    by bucket, sums before requests, so that a task holds the totals of one bucket at a time."""
    schema = pa.schema(
        [("block", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("sums", pa.binary())]
    )
    current, total, head = None, np.zeros((0, states)), 0
    for batch in batches:
        for row in range(batch.num_rows):
            bucket, asks, block, n, places, sums = (batch.column(i)[row] for i in range(6))
            bucket, n = bucket.as_py(), n.as_py()
            if bucket < 0:
                head = head + np.frombuffer(sums.as_buffer())
                continue
            if bucket != current:
                current, total = bucket, np.zeros((0, states))
            places = np.cumsum(_unpacked(places, n, np.int32))
            if asks.as_py():
                found = _packed(_parts_of(total[places]))
                columns = [[block.as_py()], [bucket], [n], [found]]
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, columns)), schema)
                continue
            if len(total) <= places[-1]:
                more = max(int(places[-1]) + 1, 2 * len(total)) - len(total)
                total = np.concatenate([total, np.zeros((more, states))])
            raw = _unpacked(sums, n * (4 + 2 * (states - 1)), np.uint8)
            own = raw[: 4 * n].view(np.int32)
            total[places] += own[:, None] * _shares(raw[4 * n :].copy().view(np.uint16), states)
    if not isinstance(head, int):
        columns = [[-1], [-1], [0], [head.tobytes()]]
        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, columns)), schema)


def _first_model(counts: DataFrame, states: int, seed: int = 11) -> Shared:
    """A random start: words of a hash class lean alike; the last row is of the unknown words."""
    classes = counts.groupBy("symbol").agg(F.sum("c"), F.count("*")).collect()
    seen, kinds = np.zeros(SYMBOLS + 1), np.zeros(SYMBOLS + 1)
    for symbol, c, v in classes:
        seen[symbol], kinds[symbol] = c, v
    kinds[SYMBOLS] = 1  # the slot of unknown words
    total, n_kinds = int(seen.sum()), int(kinds.sum()) - 1
    base = (seen + ADD * kinds) / (total + ADD * (n_kinds + 1))
    lean = np.random.default_rng(seed).gamma(1.0, 1.0, (SYMBOLS + 1, states)).clip(0.05)
    lean[SYMBOLS] = 1
    moves = np.full((states, states), 0.02 / max(1, states - 1))
    np.fill_diagonal(moves, 0.98 if states > 1 else 1.0)
    start = np.full(states, 1 / states)
    return Shared(start, moves, start, np.ones(states), total, n_kinds, lean / (base @ lean))


def _with_sums(placed: DataFrame, back: DataFrame | None) -> DataFrame:
    """Each block together with the sums of its own words."""
    if back is None:
        return placed.withColumn("got", F.lit(None).cast(_GOT))
    got = back.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "sums")).alias("got"))
    return placed.drop("symbols").join(got, "block", "left")


def train(placed: DataFrame, counts: DataFrame, states: int = STATES, rounds: int = ROUNDS):
    """Baum-Welch over the training rows of all blocks. Training cuts texts into segments of
    ``SEGMENT`` tokens, which bounds the memory of a task; scores never do. Returns the shared part
    of the model, the distributed sums of (block, bucket), or None before the first round, and the
    logarithm of the likelihood before each round."""
    context = placed.sparkSession.sparkContext
    model, back, seen = _first_model(counts, states), None, []
    if not model.total:
        return model, back, seen
    over = model.total + ADD * (model.kinds + 1)
    rest = F.sum((F.col("c") + ADD) / (F.col("c") + PRIOR)) * PRIOR / over
    last, rest = counts.agg(F.max(F.shiftright("id", PLACE_BITS)), rest).first()
    rest += ADD / over
    for _ in range(rounds):
        shared = context.broadcast(model)
        parts = _with_sums(placed, back).mapInArrow(partial(_expect, shared), _COUNTS)
        dealt = parts.repartition(last + 1, "bucket").sortWithinPartitions("bucket", "asks")
        summed = dealt.mapInArrow(partial(_add, states), _BACK)
        before, back = back, stored(summed, "sums")
        if before is not None:
            discard(before)  # a round reads the sums of the round before only
        head = sum(np.frombuffer(r["sums"]) for r in back.where("block < 0").collect())
        shared.unpersist()
        ends = np.cumsum([states, states**2, states])
        starts, moves, sizes, z = np.split(head[:-1], ends)
        share = sizes / sizes.sum()
        starts, moves = starts + 1, moves.reshape(states, states) + 1
        seen.append(float(head[-1]))
        model = Shared(
            starts / starts.sum(),
            moves / moves.sum(axis=1, keepdims=True),
            share,
            z + rest * share,
            model.total,
            model.kinds,
        )
    return model, back, seen


# --- scores ----------------------------------------------------------------------------------


def _score(model, batches: _Batches) -> _Batches:
    shared: Shared = model.value
    for batch in batches:
        for row in range(batch.num_rows):
            known, emits = _emissions(shared, batch, row)
            sizes = np.array(batch.column("sizes")[row].as_py(), np.int64)
            tokens = _tokens(batch.column("tokens")[row], sizes)
            begins = np.cumsum(sizes) - sizes
            base = np.add.reduceat(np.log10(shared.base(known))[tokens], begins)
            current = Model(shared.start, shared.moves, emits)
            chain = log_likelihoods(current, tokens, begins, sizes) / np.log(10)
            hits = np.add.reduceat((known > 0)[tokens].astype(np.int64), begins)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(batch.column("ids")[row].as_py(), pa.int64()),
                    pa.array(batch.column("held")[row].as_py(), pa.bool_()),
                    pa.array(sizes),
                    pa.array(hits),
                    pa.array(np.full(len(sizes), shared.total), pa.int64()),
                    pa.array(base),
                    pa.array(chain),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )


def score_documents(
    docs: DataFrame,
    held_out,
    id_col: str = "doc_id",
    text_col: str = "text",
    states: int = STATES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score,
    score (log10). Rows where the column ``held_out`` is true are scored but not learned from; a
    null counts as false. Null texts are empty; an empty text is its end alone. With no training
    rows every token is unknown. Rows are handled one by one, so repeated rows are repeated; an
    empty table gives an empty result; other columns are ignored."""
    ship_package(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("long"), F.coalesce(held_out, F.lit(False)), F.col(text_col)
    )
    blocks = rows.mapInArrow(_blocks, _BLOCK)
    # what is read back is the numbers as they were written, once
    with arrow_bytes(docs.sparkSession, BATCH_BYTES):
        blocks = stored(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
        counts = word_counts(blocks)
        placed = _placed(blocks, counts)
        discard(blocks)  # what the rounds need of it is in ``placed``
        model, back, _ = train(placed, counts, states, rounds)
        shared = docs.sparkSession.sparkContext.broadcast(model)
        scores = _with_sums(placed, back).mapInArrow(
            partial(_score, shared),
            "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
            "base_score double, score double",
        )
        return stored(scores, "scores")
