"""The pipeline's stages on a small corpus, each decision checked by brute force."""

import random
from pathlib import Path

import corpus_pipeline
import __spark_entry__ as contract
from llm.test_language_words import corpus
from panelcast.session import shared_dir


def test_entry_registers_ten_operators_and_the_pipeline():
    names = contract.queries()
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))


def test_stages_keep_and_drop_what_they_should(spark, tmp_path):
    rows, items, gone = corpus(random.Random(6))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id",
        "exact_dedup",
        "near_dedup",
        "decontamination",
        "sentencepiece",
    ]
    left = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = sorted(r[0] for r in rows)
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, str(tmp_path))
        ids = sorted(set(ids) - gone.get(name, set()))
        assert sorted(r.doc_id for r in left.select("doc_id").collect()) == ids, name
        if name != "sentencepiece":
            assert left.columns == docs.columns
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == ids
    assert all(r.round_trip and r.n_pieces > 0 for r in out)


def test_stages_leave_only_what_their_result_reads(spark, tmp_path):
    rows, items, _ = corpus(random.Random(6))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    folder = Path(shared_dir(spark).removeprefix("file:"))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        before = set(folder.iterdir())
        left = stage(spark, docs, str(tmp_path))
        added = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
        assert len(added) == 1, (name, added)
        assert 0 < left.count() < docs.count(), name
