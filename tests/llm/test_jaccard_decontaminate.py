"""The similarity join and the positional index against brute force."""

import random
import re

import pytest

from panelcast.llm import common, decontaminate, jaccard
from panelcast.llm.common import components

VOCAB = [f"w{i}" for i in range(60)]


def _shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def _components(pairs, size, percent):
    sets = [_shingles(t, size) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            both, any_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both and 100 * both >= percent * any_:
                root[find(i)] = find(j)
    members = {}
    for i, (doc, _) in enumerate(pairs):
        members.setdefault(find(i), []).append(doc)
    return [(d, len(sets[i]), min(members[find(i)])) for i, (d, _) in enumerate(pairs)]


def _corpus(seed, n=160):
    rng = random.Random(seed)
    bases = [[rng.choice(VOCAB) for _ in range(rng.choice((2, 5, 30, 80)))] for _ in range(12)]
    pairs = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 2, 3, 5))):
            at = rng.randrange(len(words))
            words[at] = rng.choice((rng.choice(VOCAB), f"new{i}"))
        if rng.random() < 0.3:
            words += words[: rng.randrange(1, 4)]
        pairs.append((i, rng.choice((" ", "\n", "  ")).join(words).upper() if i % 7 == 0 else " ".join(words)))
    return pairs + [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, None), (3, pairs[5][1])]


@pytest.mark.parametrize("seed,size,percent,rounds", [(1, 3, 90, 3), (2, 5, 80, 0), (3, 3, 80, 1)])
def test_components_equal_brute_force(docs_of, seed, size, percent, rounds):
    pairs = _corpus(seed)
    found = jaccard.similar_documents(docs_of(pairs, clash=True), size, percent, rounds=rounds)
    rows = sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect())
    assert rows == sorted(_components(pairs, size, percent))


def test_one_of_each_component_stays(docs_of):
    text = " ".join(VOCAB)
    pairs = [(4, text), (2, text + " more"), (9, "other words of this text"), (5, None), (6, None)]
    docs = docs_of(pairs, clash=True)
    left = jaccard.drop_similar(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [2, 5, 6, 9]


def test_join_of_nothing(docs_of):
    assert jaccard.similar_documents(docs_of([])).count() == 0
    assert jaccard.drop_similar(docs_of([(1, None)])).count() == 1


def test_closed_lists_and_sets_of_other_rounds_are_not_read_again(docs_of, monkeypatch):
    # a group whose lists close in the first pivot round, and one whose members never link
    near = [(i, " ".join([*VOCAB, f"x{i}"])) for i in range(80)]
    loose = [(100 + i, " ".join([*(f"b{j}" for j in range(13)), f"y{i}", f"z{i}"])) for i in range(80)]
    # linked by shingles of their own, in the first round
    short = [(200 + i, " ".join([*(f"s{i // 2}t{j}" for j in range(40)), f"u{i}"])) for i in range(20)]
    placed, compared, read = [], [], []
    stored, read_sets = jaccard.stored, jaccard._Join.read_sets

    def keep(df, name, *rest):
        table = stored(df, name, *rest)
        if name == "placed":
            placed.append(table.count())
        return table

    def ask(self, pairs):
        sets = read_sets(self, pairs)
        read.append(sets.count())
        compared.append(pairs.select("a").union(pairs.select("b")).distinct().count())
        return sets

    monkeypatch.setattr(jaccard, "stored", keep)
    monkeypatch.setattr(jaccard._Join, "read_sets", ask)
    pairs = near + short
    found = jaccard.similar_documents(docs_of(pairs), 5, 80)
    rows = sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect())
    assert rows == sorted(_components(pairs, 5, 80))
    assert len(placed) == 2
    assert len(read) == 2 and read == compared
    placed.clear()
    found = jaccard.similar_documents(docs_of(near + loose), 5, 80)
    rows = sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect())
    assert rows == sorted(_components(near + loose, 5, 80))
    assert len(placed) == jaccard.PIVOT_ROUNDS + 1 and placed[2] == placed[3] == len(loose) < placed[0]


def test_pairs_of_a_group_are_taken_from_one_list(docs_of, monkeypatch):
    rng = random.Random(4)
    # a group of near copies, each with changes of its own
    pairs = []
    for i in range(90):
        words = [f"g{j}" for j in range(300)]
        for at in rng.sample(range(300), rng.randrange(3, 9)):
            words[at] = f"new{i}"
        pairs.append((i, " ".join(words)))
    made = []
    compare = jaccard._Join.compare

    def count(self, left, right, where, once=None):
        other = right.select("shingle", *[right[c].alias(f"y_{c}") for c in right.columns if c != "shingle"])
        joined = left.join(other, "shingle").where(where & jaccard._passes(self.percent, "", "y_"))
        found = compare(self, left, right, where, once)
        rows = joined.count() if once is None else joined.where(once).count()
        made.append((rows, found.count(), joined.count(), compare(self, left, right, where).count()))
        return found

    monkeypatch.setattr(jaccard._Join, "compare", count)
    monkeypatch.setattr(jaccard, "FULL_LIST", 1000)
    found = jaccard.similar_documents(docs_of(pairs), 5, 80)
    rows = sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect())
    assert rows == sorted(_components(pairs, 5, 80))
    rows, taken, all_rows, all_pairs = made[0]
    assert taken == all_pairs > 0
    assert rows < 1.1 * taken and all_rows > 3 * taken


def test_lists_of_equal_classes_are_kept_once(docs_of):
    pairs = [(i, " ".join([*(f"t{j}" for j in range(200)), f"x{i}"])) for i in range(2)]
    join = jaccard._Join(docs_of(pairs), 5, 80, "doc_id", "text")
    assert sorted(r["size"] for r in join.postings().collect()) == [2, 2]


def test_long_chain_of_links(spark):
    rows = [(i, i + 1) for i in range(300)] + [(1000, 1000), (2000, 1999)]
    found = {r.id: r.component for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(301))
    assert found[2000] == found[1999] == 1999 and 1000 not in found


def test_stars_of_links_take_one_round(spark, monkeypatch):
    written = []
    stored = common.stored

    def keep(df, name, *rest):
        written.append(name)
        return stored(df, name, *rest)

    monkeypatch.setattr(common, "stored", keep)
    rows = [(25, i) for i in range(50)] + [(100, i) for i in range(101, 120)]
    found = components(spark.createDataFrame(rows, "a long, b long"))
    assert written == ["components"]
    want = {i: 0 for i in range(50)} | {i: 100 for i in range(100, 120)}
    assert {r.id: r.component for r in found.collect()} == want
    assert components(spark.createDataFrame([(3, 3)], "a long, b long")).isEmpty()


def _words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def _hits(pairs, items, size=10):
    windows = {}
    for item, text in items:
        w = _words(text)
        for s in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[s : s + size]), set()).add(str(item))
    out = []
    for doc, text in pairs:
        w, hit, found = _words(text), set(), set()
        for window, names in windows.items():
            for s in range(len(w) - len(window) + 1):
                if tuple(w[s : s + len(window)]) == window:
                    hit |= set(range(s, s + len(window)))
                    found |= names
        out.append((doc, len(hit), len(found)))
    return sorted(x for x in out if x[1])


def test_contamination_equals_brute_force(spark, docs_of):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice(VOCAB) for _ in range(rng.choice((3, 9, 10, 25))))) for i in range(12)]
    items += [(90, None), (91, "!!"), (92, "w1"), (93, "Élan ÉLAN w2 W3"), (94, items[3][1])]
    pairs = []
    for i in range(60):
        words = [rng.choice(VOCAB) for _ in range(40)]
        if i % 3:
            source = rng.choice(items)[1] or ""
            words[10:10] = source.upper().split() if i % 2 else source.split()
        pairs.append((i, ", ".join(words)))
    pairs += [(100, None), (101, ""), (102, "élan élan w2 w3"), (103, "x Élan ÉLAN W2 w3 y")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(pairs, clash=True)
    found = decontaminate.contamination(docs, benchmark)
    keyed = found.join(docs.select("doc_id", *decontaminate.row_key()), ["_k1", "_k2"])
    rows = sorted((r.doc_id, r.n_hit, r.n_items) for r in keyed.collect())
    assert rows == _hits(pairs, items)
    clean = {r.doc_id for r in decontaminate.decontaminate(docs, benchmark).collect()}
    assert clean == {d for d, _ in pairs} - {d for d, _, _ in rows}


def test_contamination_of_nothing(spark, docs_of):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs_of([(1, "a b")]), empty).count() == 0
    full = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.contamination(docs_of([]), full).count() == 0
    twice = decontaminate.contamination(docs_of([(1, "a b"), (1, "a b"), (None, "x a b")]), full)
    assert [r.n_hit for r in twice.collect()] == [2, 2]


def test_proximity_finds_terms_in_any_order(spark, docs_of):
    benchmark = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    pairs = [
        (1, "blue x red y green"),
        (2, "red " + "x " * 9 + "green blue"),
        (3, "red red green"),
        (4, "Green, red; blue"),
    ]
    docs = docs_of(pairs)
    windows, _ = decontaminate.benchmark_windows(benchmark)
    index = decontaminate.build_index(docs, spark.createDataFrame([("red",), ("green",), ("blue",)], "word string"))
    ranked = decontaminate.ranked_terms(index, windows)
    found = decontaminate.proximity_matches(index, ranked, slop=4)
    assert {r["_k1"] for r in found.collect()} == {1, 4}
    assert decontaminate.phrase_matches(index, ranked).count() == 0
