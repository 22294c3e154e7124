"""Exact dedup, sharding and chat formatting against brute force and exact round trips."""

import json
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from panelcast.llm import chat, dedup, shards

LONG = "word " * 40_000
PAIRS = [
    (1, "same text"),
    (2, "same text"),
    (3, "Same text"),
    (4, None),
    (5, ""),
    (None, "same text"),
    (6, LONG),
    (7, LONG),
    (8, LONG + "x"),
    (9, "same texT"),
    (2, "same text"),
    (10, "alone"),
]


def test_exact_duplicates_equal_brute_force(docs_of):
    groups = defaultdict(list)
    for i, t in PAIRS:
        groups[t or ""].append(i)
    want = sorted(
        (repr(i), repr(max(x for x in groups[t or ""] if x is not None)), len(groups[t or ""]))
        for i, t in PAIRS
    )
    found = dedup.exact_duplicates(docs_of(PAIRS, clash=True)).collect()
    assert sorted((repr(r.doc_id), repr(r.keep_id), r.group_size) for r in found) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in found)


def test_dropping_keeps_columns_and_one_text_each(docs_of):
    docs = docs_of(PAIRS, clash=True)
    left = dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    ids = sorted(r.doc_id for r in left.collect())
    assert ids == [2, 2, 3, 5, 7, 8, 9, 10]  # rows that repeat the id that stays are kept


def test_dedup_of_nothing_and_of_nulls(docs_of):
    assert dedup.exact_duplicates(docs_of([])).count() == 0
    rows = dedup.exact_duplicates(docs_of([(None, None), (None, "")])).collect()
    assert [(r.keep_id, r.group_size, r.kept) for r in rows] == [(None, 2, True)] * 2


def _brute_shards(rows, limit):
    """Split oversized buckets bit by bit."""
    import hashlib

    def bits(i):
        key = "" if i is None else str(i)
        return int(hashlib.md5(key.encode()).hexdigest()[:15], 16)

    out, queue = {}, [("", rows)]
    while queue:
        name, part = queue.pop()
        if sum(n for _, n in part) <= limit:
            for i, _ in part:
                out[i] = "s" + name
            continue
        for bit in "01":
            d = len(name)
            queue.append((name + bit, [r for r in part if (bits(r[0]) >> (59 - d)) & 1 == int(bit)]))
    return out


def test_shards_equal_brute_force_and_fit(docs_of):
    pairs = [(i, "ä" * (i % 50)) for i in range(300)] + [(300, None)]
    found = shards.assign_shards(docs_of(pairs, clash=True), 500).collect()
    want = _brute_shards([(i, len((t or "").encode())) for i, t in pairs], 500)
    assert {r.doc_id: r.shard for r in found} == want
    assert max(r.shard_bytes for r in found) <= 500 and len({r.shard for r in found}) > 10


def test_shards_of_repeated_ids_large_texts_and_nothing(docs_of):
    found = shards.assign_shards(docs_of([(1, "x" * 100)] * 40 + [(None, "y" * 900)]), 400).collect()
    assert len(found) == 41
    assert all(r.shard_bytes <= 400 or r.shard_rows == 1 for r in found)
    assert shards.assign_shards(docs_of([]), 400).count() == 0


def test_written_shards_hold_every_row(spark, docs_of, tmp_path):
    docs = docs_of([(i, "t" * i) for i in range(40)])
    path = str(tmp_path / "shards")
    shards.write_shards(docs, shards.assign_shards(docs, 200), path)
    assert spark.read.parquet(path).count() == 40


RECORDS = {
    '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}]}': [
        ("user", "hi"),
        ("assistant", "yo"),
    ],
    '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":null}]}': [
        ("user", "a"),
        ("assistant", None),
    ],
    '{"prompt":"p","completion":"c"}': [("user", "p"), ("assistant", "c")],
    '{"instruction":"do","input":"this","output":"done"}': [
        ("user", "do"),
        ("user", "this"),
        ("assistant", "done"),
    ],
    '{"system":"s","prompt":"p","response":"r"}': [
        ("system", "s"),
        ("user", "p"),
        ("assistant", "r"),
    ],
    '{"id":1,"messages":[{"role":"user","content":"hi","name":"x"},{"role":"assistant","content":"yo"}]}': [
        ("user", "hi"),
        ("assistant", "yo"),
    ],
    '{"messages":[]}': [],
    '{"messages":[{"role":"user"}],"text":"t"}': None,
    '{"source":"s","instruction":"do","output":"done"}': [("user", "do"), ("assistant", "done")],
    '{"prompt":null,"response":"r"}': [("assistant", "r")],
    '{"question":"q","answer":"a","score":{"x":[1,2]}}': [("user", "q"), ("assistant", "a")],
    '{"other":1}': None,
    "[1]": None,
    "no json": None,
}


def test_layouts_are_told_by_their_fingerprints(spark):
    rows = [(k,) for k in RECORDS] + [(None,)]
    frame = spark.createDataFrame(rows, "record string").withColumn("turns", F.lit(0))
    frame = frame.withColumnRenamed("record", "json")
    found = chat.canonical_turns(frame, "json").collect()
    for row in found:
        want = RECORDS.get(row.json)
        got = row.turns if row.turns is None else [(t.role, t.text) for t in row.turns]
        assert got == want, row.json
    assert len({r.layout for r in found if RECORDS.get(r.json)}) == 9
    assert chat.canonical_turns(frame.limit(0), "json").count() == 0


NASTY = ["\\", "\\s", "### ", "</turn>", "</turn>\n### user: x", ": ", "\\### a: </turn> ok", "", None, "é\n", "\\e\\h####  "]


def test_template_round_trip_and_loss_mask(spark):
    turns = [[("user", a), ("assistant", b), (": #", a)] for a in NASTY for b in NASTY] + [[]]
    rows = [(json.dumps(i), t) for i, t in enumerate(turns)]
    frame = spark.createDataFrame(rows, f"id string, turns {chat.TURNS}")
    out = chat.format_turns(frame)
    read = out.select(
        "id",
        "loss_spans",
        "formatted",
        chat.parse_formatted(F.col("formatted")).alias("back"),
        chat.masked_texts(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    ).collect()
    for row in read:
        want = [(r, t or "") for r, t in turns[int(row.id)]]
        assert [(t.role, t.text) for t in row.back] == want
        assert row.loss == [t for r, t in want if r == "assistant"]


def test_rows_with_clashing_names_null_ids_and_long_conversations(spark):
    rows = [(None, i % 2, "user" if i % 2 else "assistant", f"t{i}") for i in range(6)]
    rows += [(9, i, "user", "x" * (50_000 if i == 3 else i)) for i in range(3_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("record", "layout", "mapping", "row", "turns", "order"):
        frame = frame.withColumn(name, F.lit("clash"))
    plan = chat.turns_of_rows(frame)
    assert "md5" in plan._jdf.queryExecution().toString() and "schema_of_variant" in plan._jdf.queryExecution().toString()
    found = {r.conv_id: r.turns for r in plan.collect()}
    assert [(t.role, t.text) for t in found[None]] == sorted(
        [(r, t) for _, _, r, t in rows[:6]], key=lambda x: (x[0] == "user", x)
    )
    assert [len(t.text) for t in found[9]] == [50_000 if i == 3 else i for i in range(3_000)]
    other = frame.drop("conv_id", "turn", "text").limit(1).withColumns(
        {"conversation_id": F.lit(1), "index": F.lit(0), "content": F.lit("c")}
    )
    assert [(r.conversation_id, r.turns[0].text) for r in chat.turns_of_rows(other).collect()] == [(1, "c")]


def test_rows_become_conversations_in_order(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, None, None, None), (1, 1, "assistant", "b")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r.turns for r in chat.turns_of_rows(frame).collect()}
    assert [t.text for t in found[1]] == ["a", "b", "b"]
    assert [(t.role, t.text) for t in found[2]] == [(None, None)]
    assert chat.turns_of_rows(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.turns_of_rows(frame.drop("turn"))
