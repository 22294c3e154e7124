"""A small corpus with planted cases for the pipeline's test."""

SYLLABLES = {
    "aa": "ka to mi ne ru so".split(),
    "bb": "sch ung ver eit und ber".split(),
    "cc": "éo çi eau oux ré tion".split(),
}


def sentence(rng, lang, n):
    words = ("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n))
    return " ".join(words)


def corpus(rng):
    """(documents, benchmark items, ids that each stage must drop)."""
    rows = []
    for i in range(120):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, sentence(rng, lang, 60), lang))
    items = [(i, sentence(rng, "aa", 14)) for i in range(3)]
    rows += [(200, None, "aa"), (201, "", "aa"), (202, "12 34 !!", "aa")]
    rows += [(300, rows[0][1], "aa"), (301, rows[1][1], "aa"), (302, rows[1][1], "aa")]
    near = rows[2][1].split()
    rows += [(400, " ".join([*near[:-1], "other"]), rows[2][2])]
    rows += [(500, f"{rows[5][1]} {items[1][1].upper()} {rows[6][1]} {rows[7][1]}", "aa")]
    gone = {
        "language_id": {200, 201, 202},
        "exact_dedup": {0, 1, 301},
        "near_dedup": {400},
        "decontamination": {500},
    }
    documents = [(i, t, lang, "src", len(t or "")) for i, t, lang in rows]
    return documents, items, gone


def test_corpus_is_as_planned():
    import random

    documents, items, gone = corpus(random.Random(6))
    ids = [d[0] for d in documents]
    assert len(set(ids)) == len(ids) and len(items) == 3
    assert set().union(*gone.values()) <= set(ids)
