"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Pieces never hold a whitespace marker behind another character, so the best segmentation of a text
is made of the best segmentations of its words, marker included. Each worker segments every
distinct word once, many words in step, and looks the others up. A vocabulary with markers inside
pieces is served by the same search over whole texts.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from panelcast.llm.words import text_blocks
from panelcast.session import ship_package

MARK = "▁"
#: Words that a worker remembers, and words that are segmented in step.
MEMORY, LANES = 150_000, 4096
#: Bytes beyond which a word is segmented on its own.
LONG_WORD = 256
#: Fixed value: what an unknown character costs beyond the lowest score.
UNKNOWN_PENALTY = 10.0

_RUNS = re.compile(" ( *[^ ]*)")
_Batches = Iterator[pa.RecordBatch]


class DoubleArray:
    """Trie over bytes: the child of state s by byte c is ``base[s] + c`` if ``check`` there is s."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for key, value in sorted(keys.items()):
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    values.append(-1)
                node = children[node][c]
            values[node] = value
        room = len(children) + 512
        taken = bytearray(room)
        taken[0] = 1
        self.base, self.check, self.value = {0: 0}, {0: 0}, {0: values[0]}
        base, low, queue = {}, 1, deque([(0, 0)])
        while queue:
            node, slot = queue.popleft()
            codes = sorted(children[node])
            if not codes:
                continue
            while taken[low]:
                low += 1
            free, tries = low, 0
            while True:
                at = free - codes[0]
                if at + 256 >= len(taken):
                    taken.extend(bytes(len(taken)))
                if at >= 0 and not any(taken[at + c] for c in codes):
                    break
                free, tries = free + 1, tries + 1
                while free < len(taken) and taken[free]:
                    free += 1
                if free >= len(taken):
                    taken.extend(bytes(len(taken)))
            if tries > 200:  # a crowded stretch: leave its gaps for nodes with a single child
                low += 1
            base[slot] = at
            for c in codes:
                taken[at + c] = 1
                self.check[at + c] = slot
                self.value[at + c] = values[children[node][c]]
                queue.append((children[node][c], at + c))
        size = max(self.check) + 257

        def filled(entries, default):
            out = np.full(size, default, np.int32)
            out[list(entries)] = list(entries.values())
            return out

        self.base = filled(base, 0)
        self.check = filled(self.check, -1)
        self.check[0] = -1
        self.value = filled(self.value, -1)


@dataclass
class Pieces:
    """A vocabulary: pieces by id, scores, ids of the 256 byte pieces (-1: none), unknown's id."""

    texts: list[str]
    scores: np.ndarray
    byte_ids: np.ndarray
    unknown: int
    silent: frozenset[int]

    def __post_init__(self):
        bytes_of = {int(i): b for b, i in enumerate(self.byte_ids) if i >= 0}
        own = [
            i for i in range(len(self.texts))
            if i not in bytes_of and i not in self.silent and i != self.unknown and self.texts[i]
        ]
        self.trie = DoubleArray({self.texts[i].encode(): i for i in own})
        self.lowest = float(min((self.scores[i] for i in own), default=0.0))
        self.by_word = not any(MARK in t.lstrip(MARK) for t in (self.texts[i] for i in own))
        spoken = [
            bytes([bytes_of[i]]) if i in bytes_of
            else b"" if i in self.silent
            else " ⁇ ".encode() if i == self.unknown
            else t.replace(MARK, " ").encode()
            for i, t in enumerate(self.texts)
        ]
        self.spoken = np.frombuffer(b"".join(spoken), np.uint8)
        self.spoken_size = np.array([len(s) for s in spoken], np.int64)
        self.spoken_at = np.cumsum(self.spoken_size) - self.spoken_size

    @cached_property
    def plain(self) -> list[list]:
        """The trie and the scores as lists, which take ten times the room: for long words only."""
        return [a.tolist() for a in (self.trie.base, self.trie.check, self.trie.value, self.scores)]


def load_pieces(path: str) -> Pieces:
    """Read a vocabulary file with the installed library; only pieces and scores are used."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    texts = [model.id_to_piece(i) for i in range(n)]
    byte_ids = np.full(256, -1, np.int64)
    for i in range(n):
        if model.is_byte(i):
            byte_ids[int(texts[i][3:5], 16)] = i
    silent = frozenset(i for i in range(n) if model.is_control(i) or model.is_unused(i))
    scores = np.array([model.get_score(i) for i in range(n)])
    return Pieces(texts, scores, byte_ids, model.unk_id(), silent)


def _segment(model: Pieces, words: list[bytes]) -> list[np.ndarray]:
    """Best ids of each word. Of equal scores, the longer last piece wins."""
    trie = model.trie
    sizes = np.array([len(w) for w in words])
    longest = int(sizes.max())
    grid = np.zeros((len(words), longest + 1), np.int64)
    for i, w in enumerate(words):
        grid[i, : len(w)] = np.frombuffer(w, np.uint8)
    best = np.full(grid.shape, -np.inf)
    best[:, 0] = 0
    came = np.zeros(grid.shape, np.int32)
    via = np.zeros(grid.shape, np.int32)
    rows_all = np.arange(len(words))
    for start in range(longest):
        open_rows = rows_all[(best[:, start] > -np.inf) & (start < sizes)]
        if not len(open_rows):
            continue
        lead = grid[open_rows, start]
        width = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
        single = np.zeros(len(words), bool)
        rows, state, end = open_rows, np.zeros(len(open_rows), np.int64), start
        wide = np.zeros(len(words), np.int64)
        wide[open_rows] = width
        while len(rows):
            to = trie.base[state] + grid[rows, end]
            on = (trie.check[to] == state) & (end < sizes[rows])
            rows, state = rows[on], to[on]
            if not len(rows):
                break
            end += 1
            ids = trie.value[state]
            hit = ids >= 0
            at, ids = rows[hit], ids[hit]
            single[at[wide[at] == end - start]] = True
            score = best[at, start] + model.scores[ids]
            better = score > best[at, end]
            at = at[better]
            best[at, end], came[at, end], via[at, end] = score[better], start, ids[better]
        alone = ~single[open_rows]
        for size in np.unique(width[alone]):
            at = open_rows[alone & (width == size)]
            end = np.minimum(start + size, sizes[at])
            score = best[at, start] + model.lowest - UNKNOWN_PENALTY
            better = score > best[at, end]
            at, end = at[better], end[better]
            best[at, end] = score[better]
            if model.byte_ids.min() >= 0:
                for step in range(size):
                    inner = start + step + 1 <= end
                    came[at[inner], start + step + 1] = start + step
                    via[at[inner], start + step + 1] = model.byte_ids[grid[at[inner], start + step]]
            else:
                came[at, end], via[at, end] = start, model.unknown
    where, back = sizes.copy(), []
    while (where > 0).any():
        back.append(np.where(where > 0, via[rows_all, where], -1))
        where = np.where(where > 0, came[rows_all, where], 0)
    back = np.array(back[::-1], np.int32).reshape(len(back), len(words)).T
    return [row[row >= 0] for row in back]


def _segment_long(model: Pieces, word: bytes) -> np.ndarray:
    """The same for one word, step by step: best for words that none others keep pace with."""
    base, check, value, scores = model.plain
    size = len(word)
    best = [float("-inf")] * (size + 1)
    came, via = [0] * (size + 1), [0] * (size + 1)
    best[0] = 0.0
    whole = model.byte_ids.min() >= 0
    for start in range(size):
        so_far = best[start]
        if so_far == float("-inf"):
            continue
        lead = word[start]
        after = min(size, start + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0))
        single, state, end = False, 0, start
        while end < size:
            to = base[state] + word[end]
            if check[to] != state:
                break
            state, end = to, end + 1
            if value[state] >= 0:
                single |= end == after
                score = so_far + scores[value[state]]
                if score > best[end]:
                    best[end], came[end], via[end] = score, start, value[state]
        if not single and so_far + model.lowest - UNKNOWN_PENALTY > best[after]:
            best[after] = so_far + model.lowest - UNKNOWN_PENALTY
            came[after], via[after] = start, model.unknown
            for at in range(start, after) if whole else ():
                came[at + 1], via[at + 1] = at, int(model.byte_ids[word[at]])
    out, at = [], size
    while at > 0:
        out.append(via[at])
        at = came[at]
    return np.array(out[::-1], np.int32)


class _Numbers(dict):
    """Words by the order in which they were first asked for. Nothing in it refers to itself, so it
    goes at once when it is replaced, and not with a later collection of garbage."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Encoder:
    """Encodes texts with a memory of words; the memory starts afresh when it is full."""

    def __init__(self, model: Pieces, memory: int = MEMORY):
        self.model, self.memory = model, memory
        self._clear()

    def _clear(self):
        self.seen = _Numbers()
        self.flat = np.zeros(0, np.int32)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        raw = [(MARK + w.replace(" ", MARK)).encode() for w in words]
        found: list[np.ndarray] = [np.zeros(0, np.int32)] * len(raw)
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
        low = 0
        while low < len(order):
            if len(raw[order[low]]) > LONG_WORD:
                found[order[low]] = _segment_long(self.model, raw[order[low]])
                low += 1
                continue
            # words in step take lanes * longest cells
            cells = (len(raw[i]) for i in order[low + 1 : low + LANES])
            high = low + 1
            for size in cells:
                if size > LONG_WORD or size * (high - low) > LANES * 32:
                    break
                high += 1
            pick = order[low:high]
            for i, ids in zip(pick, _segment(self.model, [raw[i] for i in pick])):
                found[i] = ids
            low = high
        sizes = np.array([len(ids) for ids in found], np.int64)
        self.at = np.append(self.at, len(self.flat) + np.cumsum(sizes) - sizes)
        self.size = np.append(self.size, sizes)
        self.flat = np.concatenate([self.flat, *found])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids start)."""
        if len(self.seen) > self.memory:
            self._clear()
        known, counts, picks = len(self.seen), [], []
        look = self.seen.__getitem__
        for text in texts:
            text = text.replace(MARK, " ")
            if not text:
                words = []
            elif not self.model.by_word:
                words = [text]
            else:
                runs = "  " in text or text[0] == " "
                words = _RUNS.findall(" " + text) if runs else text.split(" ")
            picks.append(np.fromiter(map(look, words), np.int64, len(words)))
        if len(self.seen) > known:
            self._learn(list(self.seen)[known:])
        pick = np.concatenate([np.zeros(0, np.int64), *picks])
        sizes = self.size[pick]
        ids = self.flat[_spread(self.at[pick], sizes)]
        ends = np.append(0, np.cumsum(sizes))
        counts = np.append(0, np.cumsum([len(p) for p in picks])).astype(np.int64)
        return ids, ends[counts]


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions begin, begin + 1, ... of all runs, one after the other."""
    total = int(size.sum())
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(total)


def decode(model: Pieces, ids: np.ndarray, starts: np.ndarray) -> list[str]:
    """Texts of runs of ids: byte pieces are joined to UTF-8, broken bytes are replaced, and the
    first marker of a text goes. Ids outside the vocabulary are read as unknown."""
    ids = np.where((ids < 0) | (ids >= len(model.texts)), model.unknown, ids)
    sizes = model.spoken_size[ids]
    raw = model.spoken[_spread(model.spoken_at[ids], sizes)].tobytes()
    ends = np.append(0, np.cumsum(sizes))[starts]
    out = []
    for low, high in zip(ends[:-1], ends[1:]):
        part = raw[low:high]
        out.append((part[1:] if part[:1] == b" " else part).decode("utf-8", "replace"))
    return out


_WORKER: list[Encoder] = []


def _encoder(model: Pieces) -> Encoder:
    """The worker's encoder: kept for the next tasks of a model, never one per model."""
    if not _WORKER or _WORKER[0].model is not model:
        _WORKER[:] = [Encoder(model)]
    return _WORKER[0]


def _encode(model, at: int, check: bool, batches: _Batches) -> _Batches:
    encoder = _encoder(model.value)
    for batch in batches:
        for first, end, data, offsets in text_blocks(batch.column(at)):
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])]
            ids, starts = encoder.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))
            added = {"n_pieces": pa.array(np.diff(starts), pa.int64()), "ids": lists}
            if check:
                back = decode(model.value, ids, starts)
                hashes = [hashlib.sha256(t.encode()).hexdigest() for t in back]
                added["decoded_sha256"] = pa.array(hashes, pa.string())
                added["round_trip"] = pa.array([a == b for a, b in zip(back, texts)], pa.bool_())
            part = batch.slice(first, end - first)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, *added.values()], [*batch.schema.names, *added]
            )


def _decode(model, at: int, batches: _Batches) -> _Batches:
    for batch in batches:
        step = 512
        for low in range(0, batch.num_rows, step):
            part = batch.slice(low, step)
            lists = part.column(at).fill_null([])
            starts = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
            ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            texts = decode(model.value, ids.astype(np.int64), starts.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"]
            )


def encode_documents(
    docs: DataFrame, model: Pieces, text_col: str = "text", check: bool = False
) -> DataFrame:
    """``docs`` with ``ids`` and ``n_pieces``; columns of these names are replaced. Null and empty
    texts have no ids. A literal whitespace marker in a text counts as a space.

    With ``check`` the ids are decoded again at once: ``decoded_sha256``, and ``round_trip``, whether
    the text came back. One pass does both, and no decoded text leaves the worker."""
    ship_package(docs.sparkSession)
    rows = docs.drop("n_pieces", "ids", *(["decoded_sha256", "round_trip"] if check else []))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [StructField("n_pieces", LongType()), StructField("ids", ArrayType(IntegerType()))]
    if check:
        added += [StructField("decoded_sha256", StringType()), StructField("round_trip", BooleanType())]
    schema = StructType([*rows.schema.fields, *added])
    return rows.mapInArrow(partial(_encode, shared, rows.columns.index(text_col), check), schema)


def decode_documents(rows: DataFrame, model: Pieces, ids_col: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``; a column of this name is replaced. Null lists decode to empty."""
    ship_package(rows.sparkSession)
    kept = rows.drop("decoded")
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*kept.schema.fields, StructField("decoded", StringType())])
    return kept.mapInArrow(partial(_decode, shared, kept.columns.index(ids_col)), schema)
