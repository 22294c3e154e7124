import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs; extra columns clash with the operators' outputs."""

    def build(pairs, clash=False):
        rows = [(i, t, "en", "src0", len(t or "")) for i, t in pairs]
        frame = spark.createDataFrame(rows, DOCS)
        if clash:
            from pyspark.sql import functions as F

            for name in ("kept", "keep_id", "component_id", "ids", "lang_pred", "score", "shard"):
                frame = frame.withColumn(name, F.lit("x"))
        return frame

    return build
