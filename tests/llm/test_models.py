"""Pieces, language ID, the Markov model, personal data and host links: brute force and accuracy."""

import gc
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelcast.llm import catalog, hmm, langid, links, pieces, pii

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


# --- pieces ----------------------------------------------------------------------------------


def _tiny(byte_pieces=True):
    texts = ["<unk>", "▁", "a", "b", "c", "ab", "▁a", "▁ab", "bc", "cab", "é", "▁▁", "abc"]
    scores = [0, -9, -4, -4.5, -4, -6, -7, -8, -7, -9.5, -5, -10, -9]
    byte_ids = np.full(256, -1, np.int64)
    if byte_pieces:
        byte_ids = np.arange(len(texts), len(texts) + 256)
        texts = texts + [f"<0x{b:02X}>" for b in range(256)]
        scores = scores + [0] * 256
    return pieces.Pieces(texts, np.array(scores, float), byte_ids, 0, frozenset())


def _viterbi(model, text):
    """Over characters of the whole text; of equal scores, the longer last piece."""
    if not text:
        return []
    chars = pieces.MARK + text.replace(" ", pieces.MARK)
    special = set(model.byte_ids.tolist()) | {model.unknown}
    own = {t: i for i, t in enumerate(model.texts) if i not in special}
    best = [(0.0, [])] + [None] * len(chars)
    for end in range(1, len(chars) + 1):
        for start in range(end):
            part = chars[start:end]
            if part in own:
                step = (model.scores[own[part]], [own[part]])
            elif end == start + 1:
                ids = [int(model.byte_ids[b]) for b in part.encode()]
                step = (model.lowest - 10, ids if ids[0] >= 0 else [model.unknown])
            else:
                continue
            score = best[start][0] + step[0]
            if best[end] is None or score > best[end][0]:
                best[end] = (score, best[start][1] + step[1])
    return best[-1][1]


@pytest.mark.parametrize("byte_pieces", [True, False])
def test_encoding_equals_plain_viterbi(byte_pieces):
    model = _tiny(byte_pieces)
    rng = random.Random(3)
    texts = ["".join(p) for n in range(4) for p in itertools.product("abc ", repeat=n)]
    texts += ["".join(rng.choice("abcé x€\U0001f600 ") for _ in range(rng.randrange(1, 30))) for _ in range(200)]
    encoder = pieces.Encoder(model, memory=50)
    ids, starts = encoder.encode(texts)
    for i, text in enumerate(texts):
        assert ids[starts[i] : starts[i + 1]].tolist() == _viterbi(model, text), text
    if byte_pieces:
        assert pieces.decode(model, ids, starts) == texts


def test_forgotten_words_leave_no_garbage():
    model = _tiny()
    encoder = pieces.Encoder(model, memory=3)
    gc.collect()
    gc.disable()
    try:
        encoder.encode(["a b ab ba aab"])
        assert len(encoder.seen) == 5
        encoder.encode(["a"])
        assert len(encoder.seen) == 1 and gc.collect() == 0
    finally:
        gc.enable()
    assert "plain" not in vars(model)


def test_long_words_take_the_same_path():
    model = _tiny()
    words = ["abcab" * n for n in (1, 7, 40)] + ["é€x" * 30]
    raw = [(pieces.MARK + w).encode() for w in words]
    for word, ids in zip(raw, pieces._segment(model, raw)):
        assert pieces._segment_long(model, word).tolist() == ids.tolist()


def test_public_vocabulary_round_trip(spark, docs_of):
    texts = [None, "", "a", "  two  spaces ", "tab\tline\n", "中文 \U0001f600", "x" * 5000, "lore " * 20_000, "a"]
    docs = docs_of(list(enumerate(texts)), clash=True)
    model = pieces.load_pieces(VOCABULARY)
    coded = pieces.encode_documents(docs, model)
    rows = pieces.decode_documents(coded, model).collect()
    assert {r.doc_id: r.decoded for r in rows} == {i: t or "" for i, t in enumerate(texts)}
    assert all(r.n_pieces == len(r.ids) for r in rows)
    assert pieces.encode_documents(docs.limit(0), model).count() == 0
    broken = spark.createDataFrame([(1, [3 + 255, 10**6]), (2, None)], "i long, ids array<int>")
    assert [r.decoded for r in pieces.decode_documents(broken, model).orderBy("i").collect()] == ["\ufffd ⁇ ", ""]


# --- language --------------------------------------------------------------------------------


def _languages(n, seed):
    rng = random.Random(seed)
    syllables = {"aa": "ka to mi ne ru".split(), "bb": "sch ung ver eit und".split(), "cc": "éo çi eau oux ré".split()}
    out = []
    for i in range(n):
        lang = rng.choice(list(syllables))
        words = ("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 200)))
        out.append((i, " ".join(words), lang))
    return out


def test_held_out_accuracy_and_odd_texts(spark):
    rows = _languages(600, 1)
    schema = "doc_id long, text string, lang string"
    net = langid.fit(spark.createDataFrame(rows[:400] + [(900, None, "aa"), (901, "ka to", None)], schema))
    assert net.languages == ["aa", "bb", "cc"]
    odd = [(1000, None, "x"), (1001, "12 ...", "x"), (1002, "", "x"), (1003, "und " * 30_000, "x")]
    test = spark.createDataFrame(rows[400:] + odd, schema).withColumn("score", F.lit("clash"))
    found = {r.doc_id: r for r in langid.label_documents(test, net).collect()}
    right = sum(found[i].lang_pred == lang for i, _, lang in rows[400:])
    assert right >= 0.97 * 200
    assert [found[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "bb"]
    assert all(0 <= r.score <= 1 for r in found.values())


def test_copies_do_not_thin_out_the_sample(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(langid, "train", lambda segments, labels, names: seen.update(s=segments, l=labels, n=names))
    rows = [(i, str(max(0, i - 39_549)), "aa") for i in range(40_000)] + [(-1, "", "bb")]
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    # 451 texts, one of them with 39 550 copies: each of the 400 chosen is shorter than a segment
    assert len(set(seen["s"])) == len(seen["s"]) == langid.SAMPLE_DOCS
    assert seen["n"] == ["aa"] and set(seen["l"]) == {0}


def test_language_without_labels_or_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    net = langid.fit(empty)
    rows = spark.createDataFrame([(1, "text", None)], empty.schema)
    assert [r.lang_pred for r in langid.label_documents(rows, net).collect()] == ["und"]


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    segments = [bytes(rng.integers(97, 101, n).tolist()) for n in (5, 9, 1)]
    net = langid.train(segments, [0, 1, 0], ["x", "y"], units=3, epochs=1)
    for group in (net.inputs, net.recurrent):
        group[:] = [g.astype(np.float64) for g in group]
    net.output, net.bias = net.output.astype(float), net.bias.astype(float)
    codes, mask = np.zeros((9, 3), np.uint8), np.zeros((9, 3))
    for i, s in enumerate(segments):
        codes[: len(s), i], mask[: len(s), i] = list(s), 1

    def loss():
        probs, _, _ = langid._probabilities(net, codes, mask)
        picked = probs[:, range(3), [0, 1, 0]]
        return -(np.log(picked) * mask).sum() / mask.sum()

    grads = langid._gradients(net, codes, mask, np.array([0, 1, 0]))
    for param, grad in zip([*net.inputs, *net.recurrent, net.output, net.bias], grads):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        kept = param[at]
        param[at] = kept + 1e-3
        up = loss()
        param[at] = kept - 1e-3
        down = loss()
        param[at] = kept
        assert abs((up - down) / 2e-3 - grad[at]) < 2e-2 * max(abs(grad[at]), 1e-3)


# --- Markov model ----------------------------------------------------------------------------


def _model(k, rng):
    def rows(*shape):
        x = rng.random(shape) + 0.1
        return x / x.sum(axis=-1, keepdims=True)

    return hmm.Model(rows(k), rows(k, k), rows(k, hmm.SYMBOLS).T.copy())


def test_recursions_equal_sums_over_all_paths():
    rng = np.random.default_rng(2)
    model, k = _model(3, rng), 3
    sizes = np.array([4, 1, 3])
    codes = rng.integers(0, 5, 8)
    begins = np.cumsum(sizes) - sizes
    starts, moves, emits, total = hmm.expected_counts(model, codes, begins, sizes)
    want = [np.zeros(k), np.zeros((k, k)), np.zeros((hmm.SYMBOLS, k))]
    logs = []
    for b, n in zip(begins, sizes):
        seq, weights = codes[b : b + n], {}
        for path in itertools.product(range(k), repeat=int(n)):
            p = model.start[path[0]] * np.prod([model.emits[s, z] for s, z in zip(seq, path)])
            weights[path] = p * np.prod([model.moves[a, b] for a, b in zip(path, path[1:])])
        all_ = sum(weights.values())
        logs.append(np.log(all_))
        for path, p in weights.items():
            want[0][path[0]] += p / all_
            for a, b_ in zip(path, path[1:]):
                want[1][a, b_] += p / all_
            for s, z in zip(seq, path):
                want[2][s, z] += p / all_
    for got, exact in zip((starts, moves, emits), want):
        np.testing.assert_allclose(got, exact, rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose(hmm.log_likelihoods(model, codes, begins, sizes), logs)
    assert abs(total - sum(logs)) < 1e-9


def test_scores_equal_definition_and_beat_the_base(spark):
    rows = [(i, t) for i, t, _ in _languages(300, 4)]
    rows += [(1000, None), (1001, ""), (1002, "Ka KA unseen"), (None, "ka"), (1002, "Ka KA unseen")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    held = langid.held_out("doc_id", 10)
    found = hmm.score_documents(docs, held, states=3, rounds=6).collect()
    is_held = {r.doc_id: r.h for r in docs.select("doc_id", held.alias("h")).collect()}
    counts, split = {}, lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b""]
    for i, t in rows:
        for w in () if is_held[i] else split(t):
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    texts = dict(rows)
    assert len(found) == len(rows)
    for r in found:
        words = split(texts[r.doc_id])
        base = sum(np.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert abs(r.base_score - base) < 1e-6 and r.train_tokens == n
        assert (r.n_tokens, r.n_known) == (len(words), sum(w in counts for w in words))
    out = [r for r in found if r.held_out]
    assert out and sum(r.score for r in out) > sum(r.base_score for r in out)


def test_words_of_one_hash_class_learn_apart(spark):
    # 2^15 - 1 classes of crc32: two words of one class, each in a context of its own
    seen, pair = {}, None
    for i in itertools.count():
        word = f"w{i}"
        other = seen.setdefault(zlib.crc32(word.encode()) % (hmm.SYMBOLS - 1), word)
        if other != word:
            pair = other, word
            break
    rows = [(i, " ".join([f"left{i % 7}", pair[0], f"left{i % 5}"] * 20)) for i in range(200)]
    rows += [(i, " ".join([f"right{i % 7}", pair[1], f"right{i % 5}"] * 20)) for i in range(200, 400)]
    rows += [(1000, f"left0 {pair[0]} left1 " * 10), (1001, f"left0 {pair[1]} left1 " * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in hmm.score_documents(docs, F.col("doc_id") >= 1000, states=2).collect()}
    assert abs(found[1000].base_score - found[1001].base_score) < 1e-6
    assert found[1000].score > found[1001].score + 5


def test_scores_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = hmm.score_documents(docs, F.lit(True)).collect()
    assert [(r.n_known, r.train_tokens) for r in rows] == [(0, 0)] * 2
    assert all(np.isfinite(r.score) for r in rows)
    assert hmm.score_documents(docs.limit(0), F.lit(True)).count() == 0


# --- personal data ---------------------------------------------------------------------------

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def _plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = kind == 0
            if kind == 1:
                ok = all(int(p) <= 255 for p in m[0].split("."))
            if kind == 2:
                ok = 12 <= len(digits) <= 19 and pii._luhn(digits)
            if kind == 3:
                ok = 9 <= len(digits) <= 15
            if ok:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def test_luhn():
    assert pii._luhn("4111111111111111") and not pii._luhn("4111111111111112")


def test_base_spans_equal_the_patterns():
    rng = random.Random(9)
    parts = ["a@b.c", "@", ".", "1", "25", "256", "-", " ", "+", "x", "é", "(", ")", "4111111111111111", "10.0.0.1", "a.b@c-d.e.f", "\n", "+1 (017) 555-7713", "%"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert pii.base_spans(text) == _plain_spans(text), text
    for text in ("1" * 200_000, "a" * 200_000 + "@", "+1" + " " * 200_000, "1." * 50_000):
        pii.base_spans(text)


def test_disclosing_terms_join_the_spans(spark, docs_of):
    rng = random.Random(1)
    common = ["lorem", "ipsum", "dolor", "amet", "consectetur"]
    pairs = []
    for i in range(60):
        filler = [rng.choice(common) for _ in range(12)]
        if i < 6:
            filler[5:5] = ["Zephyrine", "x@mail.example", f"n{i}"]
        pairs.append((i, " ".join(filler)))
    pairs += [(100, None), (101, ""), (102, "Quark 10.0.0.1"), (103, "Quark 10.0.0.1"), (104, "Quark 10.0.0.1"), (0, pairs[0][1])]
    found = pii.find_spans(docs_of(pairs, clash=True)).collect()
    assert len(found) == len(pairs)
    texts = dict(pairs)
    for r in found:
        text = texts[r.doc_id] or ""
        assert [(s.kind, s.start, s.end) for s in r.base] == pii.base_spans(text)
        shown = [text[t.start : t.end] for t in r.terms]
        # copies of one text are no evidence, so Quark stays
        assert shown == (["Zephyrine"] if "Zephyrine" in text else [])
    clean = {r.doc_id: r.sanitised for r in pii.sanitise(docs_of(pairs)).collect()}
    assert "[EMAIL]" in clean[1] and "Zephyrine" not in clean[1] and clean[102] == "Quark [IP]"
    assert clean[50] == texts[50] and clean[100] == ""
    assert pii.find_spans(docs_of([])).count() == 0


def test_span_list(spark):
    row = spark.sql(
        "select array(named_struct('kind', 3, 'start', 2, 'end', 9), named_struct('kind', 0, 'start', 2, 'end', 5))"
        " as base, array(named_struct('start', 0, 'end', 1, 'action', 'remove')) as terms"
    )
    out = row.select(pii.span_list(F.col("base"), F.col("terms"))).first()[0]
    assert out == "term:0:1,email:2:5,phone:2:9"


def test_pii_query_counts_each_kind_apart(spark, docs_of, tmp_path):
    texts = [
        None,
        "plain",
        "10.0.0.1 10.0.0.2 4111111111111111",
        "+1 (017) 555-7713 then +44 20 7946 0958 then a@b.c",
        "4111111111111111",
        "a@b.c 10.0.0.1 4111-1111-1111-1111 +1 (017) 555-7713",
    ]
    docs_of(list(enumerate(texts))).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in catalog.op8_pii(spark, str(tmp_path)).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        spans, row = _plain_spans(text or ""), found[i]
        counts = [sum(s[0] == k for s in spans) for k in range(4)]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == counts
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()


# --- host links ------------------------------------------------------------------------------


def test_hosts_paths_and_rules(spark):
    rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow")]
    want = {
        "http://WWW.Example.com/en/1?x": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "https://a.example.com/en/#f": ("a.example.com", "/en/", "example.com/en/", "block"),
        "x://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "x://com?a://b/": ("com", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(want)], "page_id long, url string, html string")
    found = links.judge_pages(pages.withColumn("host", F.lit("clash")), rules).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in found] == list(want.values())
    assert links.judge_pages(pages.limit(0), rules).count() == 0


def test_propagation_equals_the_linear_system(spark):
    """A cycle, a hub, a host without links out, and a chain of 40 hosts that leads into the cycle."""
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 3), ("d", "c", 1), ("c", "end", 1)]
    chain = [f"h{i}" for i in range(40)]
    edges += [(x, y, 1) for x, y in zip(chain, [*chain[1:], "a"])]
    names = sorted({x for s, t, _ in edges for x in (s, t)})
    matrix = np.zeros((len(names), len(names)))
    for s, t, w in edges:
        matrix[names.index(s), names.index(t)] = w
    matrix /= np.maximum(matrix.sum(axis=1, keepdims=True), 1)
    seeds = {"d": 0.25, "h0": 0.75}
    seed = np.array([seeds.get(n, 0.0) for n in names])
    # what reaches a host without links goes back to the seeds
    matrix[matrix.sum(axis=1) == 0] = seed
    want = np.linalg.solve(np.eye(len(names)) - 0.85 * matrix.T, 0.15 * seed)
    frame = spark.createDataFrame(edges, "src string, dst string, weight long")
    found = links.propagate(frame, spark.createDataFrame(list(seeds.items()), "host string, seed double"))
    got = {r.host: r.score for r in found.collect()}
    assert len(got) == len(names)
    for name, value in zip(names, want):
        assert abs(got[name] - value) < 1e-5
    with pytest.raises(RuntimeError, match="after 3 rounds"):
        links.propagate(frame, spark.createDataFrame([("a", 1.0)], "host string, seed double"), rounds=3)


def test_distrust_reaches_far_hosts_and_small_shares_count(spark):
    rows = [(i, f"http://h{i}.org/", f"<a href='http://h{i + 1}.org/'>") for i in range(30)]
    rows += [(100, "http://h30.org/es/1", None), (101, "http://far.org/", None)]
    rows += [(200 + i, "http://mixed.org/" + ("es/" if i < 4 else ""), None) for i in range(10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.verdict for r in links.judge_pages(pages, [("org/es/", "block")]).collect()}
    assert all(found[i] == "block" for i in [*range(30), 100])
    assert found[101] == "allow" and found[209] == "block"


def test_distrust_flows_to_those_who_link_to_the_blocked(spark):
    rows = [
        (1, "http://bad.net/es/1", "<a href='http://worse.org/'>"),
        (2, "http://farm.org/1", '<a href="http://bad.net/es/1"> <a href="//bad.net/es/2">'),
        (3, "http://fine.org/1", "<a href=/local>"),
        (4, "http://good.com/", "<a href=http://fine.org/1>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = links.judge_pages(pages, [("com/", "allow"), ("net/es/", "block")]).collect()
    assert {r.page_id: r.verdict for r in found} == {1: "block", 2: "block", 3: "allow", 4: "allow"}


# --- added with the reworked training --------------------------------------------------------


def _dense_rounds(texts, held, states, rounds):
    """Baum-Welch of the same model in one process, with plain loops over all texts."""
    words = [[*t.lower().split(), ""] for t in texts]
    counts = {}
    for ws, h in zip(words, held):
        for w in [] if h else ws:
            counts[w] = counts.get(w, 0) + 1
    vocabulary = sorted(counts)
    c = np.array([counts[w] for w in vocabulary], float)
    total, kinds = int(c.sum()), len(c)
    over = total + hmm.ADD * (kinds + 1)
    base = (c + hmm.ADD) / over
    symbol = [0 if not w else zlib.crc32(w.encode()) % (hmm.SYMBOLS - 1) + 1 for w in vocabulary]
    lean = np.random.default_rng(11).gamma(1.0, 1.0, (hmm.SYMBOLS + 1, states)).clip(0.05)
    lean[hmm.SYMBOLS] = 1
    mass = np.zeros(hmm.SYMBOLS + 1)
    np.add.at(mass, symbol, base)
    mass[hmm.SYMBOLS] += hmm.ADD / over
    emits = base[:, None] * (lean / (mass @ lean))[symbol]
    moves = np.full((states, states), 0.02 / (states - 1))
    np.fill_diagonal(moves, 0.98)
    start = np.full(states, 1 / states)
    seen = []
    for _ in range(rounds):
        starts, steps, n, logs = np.zeros(states), np.zeros((states, states)), np.zeros((kinds, states)), 0.0
        for ws, h in zip(words, held):
            if h:
                continue
            ids = [vocabulary.index(w) for w in ws]
            a, scale = [], []
            for t, i in enumerate(ids):
                v = emits[i] * (start if not t else a[-1] @ moves)
                scale.append(v.sum())
                a.append(v / v.sum())
            logs += np.log(scale).sum()
            back = np.ones(states)
            for t in range(len(ids) - 1, -1, -1):
                n[ids[t]] += a[t] * back
                if t:
                    part = emits[ids[t]] * back / scale[t]
                    steps += a[t - 1][:, None] * moves * part
                    back = moves @ part
            starts += a[0] * back
        share = n.sum(axis=0) / n.sum()
        split = (n + hmm.PRIOR * share) / (c + hmm.PRIOR)[:, None]
        joint = base[:, None] * split
        z = joint.sum(axis=0) + hmm.ADD / over * share
        emits = joint / z
        start = (starts + 1) / (starts + 1).sum()
        moves = (steps + 1) / (steps + 1).sum(axis=1, keepdims=True)
        seen.append(logs)
    return start, moves, seen


def test_training_rounds_equal_a_dense_baum_welch(spark, docs_of, monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK_BYTES", 300)  # several blocks, and words in several of them
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["a", "b", "cc", "D", "e"] + [f"w{i}" for i in range(30)], k=rng.randint(0, 25))) for _ in range(60)]
    held = [i % 10 == 3 for i in range(60)]
    docs = docs_of(list(enumerate(texts))).repartition(3)
    rows = docs.select("doc_id", F.col("doc_id") % 10 == 3, "text").mapInArrow(hmm._blocks, hmm._BLOCK)
    from panelcast.llm.common import stored

    blocks = stored(rows.withColumn("block", F.monotonically_increasing_id()), "blocks")
    counts = hmm.word_counts(blocks)
    model, _, seen = hmm.train(hmm._placed(blocks, counts), counts, states=3, rounds=4)
    start, moves, want = _dense_rounds(texts, held, 3, 4)
    np.testing.assert_allclose(seen, want, rtol=1e-5)
    np.testing.assert_allclose(model.start, start, rtol=1e-4)
    np.testing.assert_allclose(model.moves, moves, rtol=1e-3)
    assert all(b > a for a, b in zip(seen, seen[1:]))


def test_signs_that_are_no_letters_are_und(spark, docs_of):
    signs = ["½", "²", "①", "Ⅷ", "123", "", None, "-", "\x00", "٣"]
    pairs = [(i, t) for i, t in enumerate([*signs, "ª", "字", "é"])]
    docs = docs_of(pairs)
    net = langid.train([b"hello there", b"bonjour la"], [0, 1], ["en", "fr"])
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.label_documents(docs, net).collect()}
    for i in range(len(signs)):
        assert found[i] == ("und", 0.0)
    assert all(found[i][0] in ("en", "fr") for i in range(len(signs), len(pairs)))
    kept = langid.drop_unrecognised(docs, langid.Network([]), 0.1)
    assert sorted(r.doc_id for r in kept.collect()) == [10, 11, 12]


def test_language_probabilities_equal_a_plain_forward_pass():
    net = langid.train([b"hello there my friend", b"bonjour la compagnie"] * 3, [0, 1] * 3, ["en", "fr"])
    data = np.frombuffer("bonjour, dear friend é!".encode(), np.uint8)
    offsets = np.array([0, 9, 9, len(data)])
    got = langid.document_probabilities(net, data, offsets)

    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    def run(direction, codes):
        h, out = np.zeros(langid.UNITS), []
        k = langid.UNITS
        for c in codes:
            x, g = net.inputs[direction][c], h @ net.recurrent[direction]
            update, reset = (sigmoid(2 * (x[i * k : i * k + k] + g[i * k : i * k + k])) for i in (0, 1))
            new = np.tanh(x[2 * k :] + reset * g[2 * k :])
            h = (1 - update) * h + update * new
            out.append(h)
        return np.array(out)

    for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        codes = data[a:b]
        if not len(codes):
            assert not got[row].any()
            continue
        states = np.concatenate([run(0, codes), run(1, codes[::-1])[::-1]], axis=1)
        logits = states @ net.output + net.bias
        soft = np.exp(logits - logits.max(axis=1, keepdims=True))
        want = (soft / soft.sum(axis=1, keepdims=True)).mean(axis=0)
        np.testing.assert_allclose(got[row], want, atol=1e-4)


def test_a_block_is_gathered_over_many_batches():
    def batches():
        for i in range(6):
            yield pa.RecordBatch.from_arrays(
                [pa.array([2 * i, 2 * i + 1]), pa.array([False, i == 2]), pa.array([f"a b{i}", None])],
                ["id", "held", "text"],
            )

    (block,) = hmm._blocks(batches())
    assert block["ids"][0].as_py() == list(range(12)) and block["sizes"][0].as_py() == [3, 1] * 6
    assert block["words"][0].as_py() == [b"", b"a", *(f"b{i}".encode() for i in range(6))]
    assert block["counts"][0].as_py() == [11, 6, 1, 1, 1, 1, 1, 1]
