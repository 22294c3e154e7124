"""Token counts, the Merkle manifest and phrase mining against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelcast.llm import manifest, phrases, tokens
from panelcast.llm.catalog import TOKENIZER

regex = pytest.importorskip("regex")
tokenizers = pytest.importorskip("tokenizers")


def same(got, want):
    assert sorted(map(str, got)) == sorted(map(str, want))


def clashing(frame, names):
    for name in names:
        frame = frame.withColumn(name, F.lit("x"))
    return frame


# -- token counts ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="module")
def tokenizer():
    return tokens.load_tokenizer(TOKENIZER)


def test_settled_code_points_are_cut_as_the_library_does(library):
    pattern, settled = regex.compile(tokens.PATTERN), regex.compile(tokens.SETTLED)
    wrong = []
    for code in range(0x30000):
        if 0xD800 <= code < 0xE000 or not settled.fullmatch(chr(code)):
            continue
        c = chr(code)
        text = f"a{c}1!{c} {c}{c}"
        if [x[i:j] for x in [text] for _, (i, j) in library.pre_tokenizer.pre_tokenize_str(x)] != (
            pattern.findall(text)
        ):
            wrong.append(hex(code))
    assert wrong == []


def odd_texts():
    letters = ["a", "B", "é", "1", "'s", "'", " ", "  ", "\n", "\t", "\x85", "\x1c", "!", "<|endoftext|>"]
    letters += ["՘", "\U0003fc36", "漢", "🙂", "½", "'LL", "<|", "|>", "endoftext"]
    rng = random.Random(5)
    texts = ["".join(rng.choices(letters, k=rng.choice([1, 3, 20, 200]))) for _ in range(150)]
    return [None, "", " ", "<|endoftext|>", *texts, "x" * 50_000, "it's  so \n " * 5_000]


def test_token_counts_equal_the_library(spark, docs_of, library, tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "HEAD_PIECES", 20)
    monkeypatch.setattr(tokens, "ROW_PIECES", 7)
    texts = odd_texts()
    pairs = [(i % 100 if i % 9 else None, t) for i, t in enumerate([*texts, *texts[:40]])]
    docs = clashing(docs_of(pairs), ["row", "id", "piece", "times", "n", "n_tokens", "n_bytes"])
    found = tokens.count_tokens(docs, tokenizer)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens"]
    want = [
        (i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids))
        for i, t in pairs
    ]
    same(map(tuple, found.collect()), want)


def test_token_counts_of_an_empty_table(docs_of, spark, tokenizer):
    docs = docs_of([(1, "a")]).limit(0)
    assert tokens.count_tokens(docs, tokenizer).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        tokens.load_tokenizer("/opt/tokenizers/word_bpe_49k.json")


# -- manifest -------------------------------------------------------------------------------------

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def lowered(text):
    return None if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)


def tree(leaves):
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for j, path in enumerate(paths):
            low = at[j] // 16 * 16
            run, k = nodes[low : low + 16], at[j] - low
            path.append(("".join(run[:k]), "".join(run[k + 1 :])))
            at[j] //= 16
        nodes = [digest("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def brute_manifest(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row, leaf_of(row)))
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    for key in keys:
        groups[key].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = [tree([leaf for _, leaf in groups[key]]) for key in keys]
    root, tops = tree([t[0] for t in trees])
    for key, (subroot, paths), top in zip(keys, trees, tops):
        for (row, leaf), path in zip(groups[key], paths):
            acc = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                acc = leaf_of([*row[:4], lowered(row[4])])
            for left, right in path + top:
                acc = digest(left + acc + right)
            proof = digest("".join(left + right for left, right in path + top))
            yield row[0], leaf, subroot, root, proof, acc, acc == root


def manifest_of(spark, rows):
    docs = clashing(spark.createDataFrame(rows, SCHEMA), ["g", "id", "pos", "leaf", "root", "row", "key"])
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest.manifest(
        docs,
        FIELDS,
        tampered=[*(F.col(c) for c in FIELDS[:4]), text],
        when_tampered=F.coalesce(chosen, F.lit(False)),
    )


def check_manifest(spark, rows):
    same(map(tuple, manifest_of(spark, rows).collect()), brute_manifest(rows))


def test_manifest_equals_brute_force(spark):
    rng = random.Random(2)
    ids = [*range(700), *rng.sample(range(10**6), 200), -1, -64, -65, -(2**40), 2**62, 2**63 - 1, -(2**63)]
    sources = ["a", "a", "a", "b", "é", "z", "", None]
    rows = [(i, rng.choice(sources), rng.choice([None, "en"]), i % 9, f"Text {i % 50}") for i in ids]
    check_manifest(spark, rows)


def test_manifest_of_nulls_repeats_and_ties(spark):
    rows = [(None, "a", None, None, None)] * 3 + [(None, "a", "x", 1, f"T{i}") for i in range(20)]
    rows += [(5, "a", "en", 2, "Same")] * 40 + [(5, "a", "en", 2, f"Other {i}") for i in range(5)]
    rows += [(6, "a", "en", 2, "Long " * 30_000), (5, None, "en", 2, "alone")]
    check_manifest(spark, rows)


def test_manifest_of_many_groups_and_of_one_row(spark):
    check_manifest(spark, [(i, f"s{i % 300}", "en", i, "A") for i in range(400)])
    check_manifest(spark, [(1, "s", "en", 1, "A")])


def test_manifest_of_an_empty_table(spark):
    assert manifest_of(spark, [(1, "s", "en", 1, "A")][:0]).count() == 0


def test_directory_of_several_levels_sums_the_keys_before(spark, monkeypatch):
    monkeypatch.setattr(manifest, "TOP_ENTRIES", 3)
    monkeypatch.setattr(manifest, "RUN_BITS", 2)
    rng = random.Random(3)
    rows = [(g, k, rng.randint(1, 9)) for g in "ab" for k in rng.sample(range(-500, 500), 200)]
    found = manifest.directory(spark.createDataFrame(rows, "g string, key long, n long")).collect()
    want = [(g, k, sum(n for h, j, n in rows if h == g and j < k)) for g, k, _ in rows]
    same(map(tuple, found), want)


# -- phrases --------------------------------------------------------------------------------------


def brute_phrases(rows, least, top):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        found = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered(text or "")):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, 6):
                found.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = {
            long[i : i + k]
            for long, a in cand.items()
            for k in range(2, len(long))
            for i in range(len(long) - k + 1)
            if a >= cand[long[i : i + k]]
        }
        ranked = []
        for p, a in cand.items():
            if p not in dropped:
                cuts = [(1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (score, a, p, left, right) in enumerate(sorted(ranked)[:top]):
            yield lang, i + 1, p.decode(), -a, left, right, total[lang], -score


WORDS = ["a", "B", "c.", "é", " x", ";", "\t", "\n", "dd,", "E", "ff", "\x0b", "🙂"]


def test_phrases_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [
        (rng.choice([None, "x", "und", "y\x00"]), " ".join(rng.choices(WORDS, k=rng.choice([0, 1, 3, 50, 700]))))
        for _ in range(250)
    ]
    rows += [("x", "a " * 5_000), ("x", None), ("x", ""), ("x", "\n.!"), *rows[:30] * 3]
    docs = clashing(spark.createDataFrame(rows, "lang string, text string"), ["own", "chunk", "times", "f", "a"])
    found = phrases.mine_phrases(docs, least=5, top=300)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = list(brute_phrases(rows, 5, 300))
    assert len(want) > 500
    same(map(tuple, found.collect()), want)


def test_phrases_of_tables_without_words(spark):
    docs = spark.createDataFrame([("x", None), (None, " .\n"), ("y", "")], "lang string, text string")
    assert phrases.mine_phrases(docs, least=1).count() == 0
    assert phrases.mine_phrases(docs.limit(0), least=1).count() == 0


def test_dictionary_covers_each_word_once(spark):
    text = " ".join(f"w{i % 37}" for i in range(3_000))
    docs = spark.createDataFrame([("x", text)] * 4, "lang string, text string")
    rows = phrases.parse(docs).collect()
    assert sum(r["own"] * r["times"] for r in rows) == 12_000
    assert all(r["own"] <= phrases.CHUNK_LIMIT for r in rows)
    assert len(rows) < 200  # copies and repeats share their chunks


def test_scores_are_exact_beyond_64_bits(spark):
    rng = random.Random(4)
    rows = [
        (rng.randint(100, 10**12), rng.randint(10**9, 10**14), rng.randint(100, 10**12), rng.randint(100, 10**12))
        for _ in range(500)
    ]
    frame = spark.createDataFrame(rows, "a long, n long, l long, r long")
    score = phrases._exact_quotient(*[F.col(c) for c in "anlr"])
    assert all(1000 * r.a * r.n // (r.l * r.r) == r.q for r in frame.select("*", score.alias("q")).collect())
