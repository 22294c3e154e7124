"""The corpus pipeline: each stage works on the rows that the stage before has kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
All but the last return the columns of ``documents``. ``run`` applies them and stores each result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import decontaminate, dedup, jaccard, langid, pieces
from panelcast.llm.catalog import VOCABULARY
from panelcast.llm.common import arrow_bytes, stored
from panelcast.sources.tables import read_table

#: A document goes if its best language is no further above chance than this share of the way to 1.
MIN_MARGIN = 0.1
#: Near duplicates: words of a shingle, and least similarity in percent.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Bytes of texts that are handed to Python at once.
BATCH_BYTES = 1 << 20


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go: those without a letter (null and empty texts
    among them), or of a score hardly above chance. Without labelled rows nothing is learned, and
    all documents with a letter stay. An empty table stays empty."""
    labelled = docs.where(~langid.held_out("doc_id", 5) & F.col("doc_id").isNotNull())
    return langid.drop_unrecognised(docs, langid.fit(labelled), MIN_MARGIN)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id stays; rows equal in id and text all
    do, and null counts as empty."""
    return dedup.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by similar texts, the document with the smallest doc_id stays. Texts
    without words link with nothing and stay."""
    return jaccard.drop_similar(docs, NEAR_WORDS, NEAR_PERCENT)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go. An empty benchmark drops nothing."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids of the pieces and their number, and whether they decode to the text again.
    Null and empty texts have no pieces."""
    model = pieces.load_pieces(VOCABULARY)
    with arrow_bytes(spark, BATCH_BYTES):
        found = pieces.encode_documents(docs, model, check=True).drop("decoded_sha256")
        return stored(found, "encoded")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("sentencepiece", encoded),
]

#: Stages learn a network and read a vocabulary file, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
