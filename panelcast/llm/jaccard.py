"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Sets are the distinct word shingles of a text, as 64-bit hashes. Two texts link when
``100 * intersection >= percent * union``.

1. Document frequencies of shingles are summed into a table of fixed size, by hash. Shingles are
   put in order by (frequency of their slot, hash): a total order with rare ones first.
2. Texts with equal sets form a class; one row stands for it from here on.
3. Every class posts the first ``n - ceil(percent / 100 * n) + 1`` shingles of its order. Linked
   classes share one of them, so candidates are found by an equality join on shingles.
4. Before a pair is verified it must pass the length filter, the positional filter on the places
   of the shared shingle, and the suffix filter, in two steps: 512 parity bits of each set, and the
   set's counts in 128 parts of the hash space. Differences of both bound the symmetric difference
   of the sets from below; the second step still tells long texts apart, and takes 128 bytes.
5. Each pair is verified once, on its whole sets.

A group of n near copies would have n * n / 2 pairs. Posting lists of more than ``FULL_LIST``
classes are therefore first compared with one pivot per list, for some rounds; links found so far
are contracted to components. Last, all pairs of such a list that still lie in different components
are compared. Every link either is found, or lies inside one component, so components are exact.
A list that lies in one component is closed: components only grow, so it is not read again.

Near copies share most of their lists. Of lists with equal classes one is kept, and where all pairs of
a list are compared, a pair is taken from the first list that both classes know to share.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import (
    arrow_bytes,
    bitmap,
    discard,
    drop_rows,
    maybe_in,
    row_key,
    stars,
    stored,
    stored_alone,
)
from panelcast.llm.words import mix, shingle_sets, text_blocks, word_hashes
from panelcast.session import ship_package

#: Slots of the frequency table, and the pieces in which it is summed: 4 MiB in all.
SLOTS, PIECES = 1 << 20, 64
#: Parts of the suffix filter's sketch: shingles counted by the first bits of another hash.
PARTS = 128
#: Rounds that compare posting lists with one pivot, before the rest is compared in full.
PIVOT_ROUNDS = 3
#: Longest posting list whose pairs are compared at once.
FULL_LIST = 64
#: Lists by which a class tells whether a pair was found in an earlier one.
FIRSTS = 16
#: Bytes of texts or sets that are handed to Python at once. A worker holds a few times as much, and
#: so does the JVM beside its heap.
BATCH_BYTES = 1 << 20

_BITS = [f"_b{i}" for i in range(8)]
_Batches = Iterator[pa.RecordBatch]


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    for _, _, data, offsets in text_blocks(column):
        yield from shingle_sets(*word_hashes(data, offsets), size)


def _count_slots(size: int, batches: _Batches) -> _Batches:
    table = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for _, _, data, offsets in text_blocks(batch.column(0)):
            found = shingle_sets(*word_hashes(data, offsets), size)
            table += np.bincount((np.concatenate(found) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
    pieces = table.astype(np.uint32).reshape(PIECES, -1)
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(PIECES), pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary())],
        ["piece", "counts"],
    )


def _add_pieces(batches: _Batches) -> _Batches:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            part = np.frombuffer(counts.as_buffer(), np.uint32).astype(np.uint64)
            total[piece] = total[piece] + part if piece in total else part
    wide = np.uint64(0xFFFFFFFF)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(total.keys(), pa.int32()),
            pa.array([np.minimum(t, wide).astype(np.uint32).tobytes() for t in total.values()], pa.binary()),
        ],
        ["piece", "counts"],
    )


def slot_frequencies(docs: DataFrame, size: int, text_col: str = "text") -> np.ndarray:
    """In how many texts the shingles of each slot occur, over all documents. What reaches the
    driver is the fixed table of ``SLOTS`` numbers."""
    ship_package(docs.sparkSession)
    schema = "piece int, counts binary"
    parts = docs.select(text_col).mapInArrow(partial(_count_slots, size), schema)
    summed = parts.repartition(PIECES, "piece").mapInArrow(_add_pieces, schema)
    table = np.zeros((PIECES, SLOTS // PIECES), np.uint32)
    for piece, counts in summed.collect():
        table[piece] = np.frombuffer(counts, np.uint32)
    return table.ravel()


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64), pa.int64())


def _profile(size: int, percent: int, order: Broadcast, batches: _Batches) -> _Batches:
    frequency = order.value
    for batch in batches:
        n, sums, others, bits, sketches, prefixes = [], [], [], [], [], []
        for s in _sets(batch.column(2), size):
            n.append(len(s))
            mixed = mix(s + np.uint64(1))
            sums.append(s.sum(dtype=np.uint64))
            others.append(mixed.sum(dtype=np.uint64))
            parity = np.bincount((mixed & np.uint64(511)).astype(np.int64), minlength=512) & 1
            bits.append(np.packbits(parity.astype(np.uint8)).view(np.uint64))
            keep = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
            parts = np.bincount((mixed >> np.uint64(57)).astype(np.int64), minlength=PARTS)
            sketches.append(parts.astype(np.uint8).tobytes())
            rare = np.argsort(frequency[(s & np.uint64(SLOTS - 1)).astype(np.int64)], kind="stable")
            prefixes.append(s[rare[:keep]].view(np.int64))
        words = np.array(bits, np.uint64).reshape(-1, len(_BITS))
        offsets = np.append(0, np.cumsum([len(p) for p in prefixes])).astype(np.int32)
        values = np.concatenate([np.zeros(0, np.int64), *prefixes])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(n, pa.int64()),
                _signed(sums),
                _signed(others),
                *[_signed(words[:, i].copy()) for i in range(len(_BITS))],
                pa.array(sketches, pa.binary()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
            ],
            ["_id", "_k2", "n", "_s1", "_s2", *_BITS, "sketch", "prefix"],
        )


def _set_bytes(size: int, batches: _Batches) -> _Batches:
    for batch in batches:
        sets = pa.array([s.tobytes() for s in _sets(batch.column(1), size)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["cid", "set"])


def _close(percent: int, batches: _Batches) -> _Batches:
    """Pairs (a, b, na, nb, sketch a, sketch b) whose sketches allow a link."""
    for batch in batches:
        n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
        x, y = (
            np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int16)
            for i in (4, 5)
        )
        apart = np.abs(x - y)
        apart = np.minimum(apart, 256 - apart).sum(axis=1)
        least = -(-percent * n // (100 + percent))
        yield batch.select([0, 1]).filter(pa.array(apart <= n - 2 * least))


def _verify(percent: int, batches: _Batches) -> _Batches:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _passes(percent: int, a: str, b: str) -> Column:
    """Length, positional and suffix filter of two postings with prefixes a and b."""

    def col(side: str, name: str) -> Column:
        return F.col(f"{side}{name}")

    na, nb, ia, ib = col(a, "n"), col(b, "n"), col(a, "at"), col(b, "at")
    # 100 i >= p (na + nb - i)  <=>  i >= p (na + nb) / (100 + p)
    least = F.ceil(percent * (na + nb) / (100 + percent) - 1e-9)
    length = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    place = F.least(ia, ib) + 1 + F.least(na - ia, nb - ib) - 1 >= least
    apart = sum(
        (F.bit_count(col(a, x).bitwiseXOR(col(b, x))) for x in _BITS[1:]),
        F.bit_count(col(a, _BITS[0]).bitwiseXOR(col(b, _BITS[0]))),
    )
    return length & place & (apart <= na + nb - 2 * least)


class _Join:
    def __init__(self, docs, size, percent, id_col, text_col):
        self.docs, self.size, self.percent = docs, size, percent
        self.id_col, self.text_col = id_col, text_col
        self.sets = self.tested = self.labels = None
        context = docs.sparkSession.sparkContext
        ship_package(docs.sparkSession)
        keyed = docs.select(
            F.col(id_col).cast("long").alias("_id"), row_key(id_col, text_col)[1], F.col(text_col)
        )
        with arrow_bytes(docs.sparkSession, BATCH_BYTES):
            order = context.broadcast(slot_frequencies(docs, size, text_col))
            self._store(keyed, order)

    def _store(self, keyed: DataFrame, order: Broadcast) -> None:
        size, percent = self.size, self.percent
        self.profiles = stored(
            keyed.mapInArrow(
                partial(_profile, size, percent, order),
                "_id long, _k2 long, n long, _s1 long, _s2 long, "
                + ", ".join(f"{b} long" for b in _BITS)
                + ", sketch binary, prefix array<long>",
            ),
            "profiles",
        )
        same = ["n", "_s1", "_s2"]
        grouped = (
            self.profiles.where("n > 0")
            .groupBy(*same)
            .agg(
                F.min(F.struct("_id", "_k2")).alias("_rep"),
                F.min("_id").alias("first_id"),
                *[F.first(b).alias(b) for b in _BITS],
                F.first("sketch").alias("sketch"),
                F.first("prefix").alias("prefix"),
            )
        )
        # what is read back is the ids as they were written, once
        self.classes = stored(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
        # of a text that is no representative, only its keys are read again
        whole, self.profiles = self.profiles, stored(self.profiles.select("_id", "_k2", *same), "keys")
        discard(whole)

    def postings(self) -> DataFrame:
        """(cid, shingle, n, at, size, parity bits) of the prefix shingles that ``size`` > 1 classes
        share. Of lists with the same classes one is kept: another would only repeat their pairs."""
        bare = self.classes.select(F.explode("prefix").alias("shingle"))
        counts = bare.groupBy("shingle").agg(F.count("*").alias("size")).where("size > 1")
        shared = stored(counts, "shared")
        # narrow rows until it is known which are kept, all of them: a bitmap of fixed size would let a
        # share through that grows with the corpus
        spread = self.classes.select(
            "cid", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("at", "shingle")
        )
        posted = stored(spread.join(shared.hint("merge"), "shingle"), "posted")
        discard(shared)
        lists = posted.groupBy("shingle", "size").agg(
            F.bit_xor(F.xxhash64("cid")).alias("_x"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("_y")
        )
        lists = lists.groupBy("size", "_x", "_y").agg(F.min("shingle").alias("shingle"))
        kept = stored(lists.select("shingle"), "kept")
        near = maybe_in(posted, [F.col("shingle")], bitmap(kept, ["shingle"]))
        near = near.join(kept, "shingle", "left_semi")
        found = stored(near.join(self.classes.select("cid", *_BITS), "cid"), "postings")
        for table in (posted, kept):
            discard(table)
        return found

    def close(self, pairs: DataFrame) -> DataFrame:
        """The pairs that pass the second step of the suffix filter."""
        sides = pairs
        for id_, n, sketch in (("a", "na", "x"), ("b", "nb", "y")):
            side = self.classes.select(F.col("cid").alias(id_), F.col("n").alias(n), F.col("sketch").alias(sketch))
            sides = sides.join(side, id_)
        return sides.select("a", "b", "na", "nb", "x", "y").mapInArrow(
            partial(_close, self.percent), "a long, b long"
        )

    def read_sets(self, pairs: DataFrame) -> DataFrame:
        """(cid, set) of all classes in the pairs, and few others. Only texts that no round before
        has asked for are read and hashed again."""
        ids = wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
        if self.sets is not None:
            ids = ids.join(self.sets.select("cid"), "cid", "left_anti")
        need = self.classes.join(ids, "cid", "left_semi").select(
            "cid",
            F.coalesce("_rep._id", F.lit(-1).cast("long")).alias("_k1"),
            F.col("_rep._k2").alias("_k2"),
        )
        need = stored(need, "needed")
        k1, k2 = row_key(self.id_col, self.text_col)
        near = maybe_in(self.docs, [k1, k2], bitmap(need, ["_k1", "_k2"]))
        texts = near.select(k1, k2, F.col(self.text_col).alias("_text"))
        texts = texts.groupBy("_k1", "_k2").agg(F.first("_text").alias("_text"))
        added = stored(
            texts.join(need, ["_k1", "_k2"])
            .select("cid", "_text")
            .mapInArrow(partial(_set_bytes, self.size), "cid long, set binary"),
            "sets",
        )
        discard(need)
        if self.sets is None:
            self.sets = added
            return added
        # the sets of the rounds before that these pairs don't ask for are not shuffled
        again = maybe_in(self.sets, [F.col("cid")], bitmap(wanted, ["cid"]))
        self.sets = self.sets.unionByName(added)
        return again.unionByName(added)

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) of classes, those that link."""
        sets = self.read_sets(pairs)
        joined = pairs.join(sets.select(F.col("cid").alias("a"), F.col("set").alias("x")), "a")
        joined = joined.join(sets.select(F.col("cid").alias("b"), F.col("set").alias("y")), "b")
        return joined.select("a", "b", "x", "y").mapInArrow(
            partial(_verify, self.percent), "a long, b long"
        )

    def test(self, pairs: DataFrame) -> DataFrame | None:
        """Verify pairs that were not tested before; components of all links so far. Of the links
        of the rounds before, their components are all that is read again."""
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        with arrow_bytes(pairs.sparkSession, BATCH_BYTES):
            pairs = stored(self.close(pairs), "pairs")
        if not pairs.isEmpty():
            self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
            # every row carries two whole sets
            with arrow_bytes(pairs.sparkSession, BATCH_BYTES):
                found = stored(self.links(pairs), "links")
            before, known = self.labels, found
            if before is not None:
                known = found.unionByName(before.select(F.col("id").alias("a"), F.col("component").alias("b")))
            self.labels = stars(known)
            for table in (found, before):
                if table is not None:
                    discard(table)
        return self.labels

    def placed(self, postings: DataFrame) -> DataFrame:
        """Postings with the component in which their class lies so far."""
        if self.labels is None:
            return postings.withColumn("comp", F.col("cid"))
        named = self.labels.select(F.col("id").alias("cid"), F.col("component").alias("_c"))
        found = postings.join(named, "cid", "left").withColumn("comp", F.coalesce("_c", "cid"))
        return found.drop("_c")

    def compare(
        self, left: DataFrame, right: DataFrame, where: Column, once: Column | None = None
    ) -> DataFrame:
        """Pairs (a, b) of postings of the same shingle that pass the filters, and ``once`` after
        them."""
        named = right.select("shingle", *[F.col(c).alias(f"y_{c}") for c in right.columns if c != "shingle"])
        passes = where & _passes(self.percent, "", "y_")
        pairs = left.join(named, "shingle").where(passes if once is None else passes & once)
        return pairs.select(
            F.least("cid", "y_cid").alias("a"), F.greatest("cid", "y_cid").alias("b")
        ).distinct()

    def compare_all(self, left: DataFrame, right: DataFrame, where: Column) -> DataFrame:
        """Pairs of postings like :meth:`compare`, of any two classes that ``where`` lets pass. Two
        near copies share many lists, so a pair is only taken from the first of them. Each class
        knows its first ``FIRSTS`` lists by shingle: a pair is left to an earlier list if both know
        it, which never leaves a pair to none."""
        lists = left.groupBy("cid").agg(
            F.slice(F.sort_array(F.collect_list("shingle")), 1, FIRSTS).alias("firsts")
        )
        left, right = left.join(lists, "cid"), right.join(lists, "cid")
        earliest = F.array_min(F.array_intersect("firsts", "y_firsts"))
        return self.compare(left, right, where, F.coalesce(earliest >= F.col("shingle"), F.lit(True)))

    def run(self, rounds: int) -> DataFrame | None:
        """Components (id, component) of the classes that link, but for the smallest of each."""
        postings = self.postings()
        short = postings.where(F.col("size") <= FULL_LIST)
        self.test(self.compare_all(short, short, F.col("cid") < F.col("y_cid")))
        table = stored(postings.where(F.col("size") > FULL_LIST).drop("size"), "long")
        discard(postings)
        long, columns, passed = table, table.columns, [table]
        for turn in range(rounds + 1):
            table = stored(self.placed(long), "placed")
            for before in passed:
                discard(before)
            pivot = F.xxhash64("cid", F.lit(turn))
            lists = table.groupBy("shingle").agg(
                F.min("comp").alias("_low"), F.max("comp").alias("_high"), F.min(pivot).alias("_p")
            )
            lists = stored(lists.where("_low < _high").select("shingle", "_p"), "lists")
            passed = [table, lists]
            if lists.isEmpty():
                break
            opened = maybe_in(table, [F.col("shingle")], bitmap(lists, ["shingle"]))
            apart = F.col("comp") != F.col("y_comp")
            compare = self.compare if turn < rounds else self.compare_all
            if turn < rounds:
                others = maybe_in(table, [F.col("shingle"), pivot], bitmap(lists, ["shingle", "_p"]))
                others = others.withColumn("_p", pivot).join(lists, ["shingle", "_p"], "left_semi").drop("_p")
            else:
                others = opened.join(lists, "shingle", "left_semi")
                apart &= F.col("cid") < F.col("y_cid")
            self.test(compare(opened, others, apart))
            long = opened.select(*columns)
        for before in passed:
            discard(before)
        return self.labels


def similar_documents(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = PIVOT_ROUNDS,
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, and the row key's _k2.

    ``component_id`` is the smallest id that can be reached by links, the row's own included.
    Null, empty and wordless texts have no shingles and link with nothing, copies of them included.
    Null ids can link but name no component unless all ids of it are null. Rows that repeat an id
    link by their texts like any others. An empty table gives an empty result; other columns are
    ignored.
    """
    join = _Join(docs, size, percent, id_col, text_col)
    labels = join.run(rounds)
    named = join.classes.select("n", "_s1", "_s2", "cid", "first_id")
    if labels is not None:
        label = labels.select(F.col("id").alias("cid"), "component")
        named = named.join(label, "cid", "left").withColumn(
            "component", F.coalesce("component", "cid")
        )
        named = stored(named, "named")
        first = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
        named = named.join(stored(first, "firsts"), "component")
    else:
        named = named.withColumn("component_id", F.col("first_id"))
    named = stored(named.select("n", "_s1", "_s2", "component_id"), "named")
    return join.profiles.join(named, ["n", "_s1", "_s2"], "left").select(
        F.col("_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "_id").alias("component_id"),
        "_k2",
    )


def drop_similar(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component stays, the one with the smallest id; all columns are kept.
    Rows of a component that repeat that id stay too."""

    def keys() -> DataFrame:
        found = similar_documents(docs, size, percent)
        dropped = found.where("doc_id <> component_id or (doc_id is null and component_id is not null)")
        return dropped.select(F.coalesce("doc_id", F.lit(-1).cast("long")).alias("_k1"), "_k2")

    return drop_rows(docs, stored_alone(keys, "similar-dropped"))
