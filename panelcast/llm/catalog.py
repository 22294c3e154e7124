"""Registered queries of this subpackage: each takes (spark, folder of Parquet tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import (
    chat,
    decontaminate,
    dedup,
    hmm,
    jaccard,
    langid,
    links,
    manifest,
    phrases,
    pieces,
    pii,
    shards,
    tokens,
)
from panelcast.llm.common import ascii_lower, row_key, stored, text_of
from panelcast.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

#: Vocabulary file of op4: a public tokenizer of the machine, read on the driver.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Byte-level BPE file of op11, and the tokens beyond which a document counts as too long.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
TOKEN_LIMIT = 512
#: Byte limit of a shard of op10.
SHARD_BYTES = 1 << 20


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


@query
def op1_exact_dedup(spark, folder):
    sha = F.sha2(text_of().cast("binary"), 256)
    docs = read_table(spark, folder, "documents")
    return dedup.exact_duplicates(docs, carry={"text_sha256": sha}).drop("_k2")


@query
def op2_chat_formatting(spark, folder):
    rows = read_table(spark, folder, "conversations")
    # conversation -7, whose texts hold the template's control strings
    probe = r"'\### Assistant: </turn> ok'"
    extra = spark.sql(
        "SELECT * FROM VALUES (-7L, 0L, 'user', r" + probe + "), (-7L, 1L, 'assistant', r" + probe + ") "
        "AS t(conv_id, turn, role, text)"
    )
    turns = chat.turns_of_rows(rows.select(extra.columns).unionByName(extra))
    out = chat.format_turns(turns)
    read = chat.parse_formatted(F.col("formatted"))
    lines = F.array_join(
        F.transform("_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    loss = F.array_join(chat.masked_texts(F.col("formatted"), F.col("loss_spans")), "")
    return out.withColumns({"_read": read, "_loss": loss}).select(
        "conv_id",
        F.size("_read").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op3_jaccard_join(spark, folder):
    docs = read_table(spark, folder, "documents")
    return jaccard.similar_documents(docs, size=3, percent=90).drop("_k2")


@query
def op4_sentencepiece(spark, folder, vocabulary: str = VOCABULARY):
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    model = pieces.load_pieces(vocabulary)
    return pieces.encode_documents(docs, model, check=True).drop("text")


@query
def op5_language_id(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id", "text", "lang")
    held = langid.held_out("doc_id", 5)
    net = langid.fit(docs.where(~held & F.col("doc_id").isNotNull()))
    found = langid.label_documents(docs.select("doc_id", "text"), net)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query
def op6_hmm_scoring(spark, folder):
    docs = read_table(spark, folder, "documents")
    return hmm.score_documents(docs, langid.held_out("doc_id", 10))


@query
def op7_decontamination(spark, folder):
    docs = read_table(spark, folder, "documents")
    hits = decontaminate.contamination(docs, read_table(spark, folder, "benchmark"))
    rows = docs.select(
        "doc_id",
        *row_key(),
        F.size(decontaminate.words_of()).cast("long").alias("n_words"),
    )
    zero = F.lit(0).cast("long")
    return rows.join(stored(hits, "hits"), ["_k1", "_k2"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


@query
def op8_pii(spark, folder):
    found = pii.find_spans(read_table(spark, folder, "documents"))
    base = pii.span_list(F.col("base"))
    return found.select(
        "doc_id",
        *[pii.count_of(F.col("base"), name).alias(f"n_{name}") for name in pii.KINDS[:4]],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        pii.span_list(F.col("base"), F.col("terms")).alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )


#: Rules of op9: fixed values.
URL_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]


@query
def op9_url_filter(spark, folder):
    return links.judge_pages(read_table(spark, folder, "pages"), URL_RULES)


@query
def op10_extendible_shards(spark, folder):
    return shards.assign_shards(read_table(spark, folder, "documents"), SHARD_BYTES)


@query
def op11_token_counts(spark, folder):
    docs = read_table(spark, folder, "documents")
    found = tokens.count_tokens(docs, tokens.load_tokenizer(TOKENIZER))
    return found.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query
def op12_merkle_manifest(spark, folder):
    docs = read_table(spark, folder, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = [*(F.col(c) for c in fields[:-1]), ascii_lower(F.col("text"))]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest.manifest(
        docs, fields, tampered=lowered, when_tampered=F.coalesce(chosen, F.lit(False))
    )


@query
def op13_phrase_collocations(spark, folder):
    return phrases.mine_phrases(read_table(spark, folder, "documents"))
