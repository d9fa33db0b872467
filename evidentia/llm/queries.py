"""The corpus operators applied, with production parameters, to their whole tables: queries() and oracle_sql()."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import byte_bpe, chat, decontaminate, fingerprints, language_model, near_duplicates, substrings, token_counts, toxicity, url_filter
from .common import small_batches


def _table(spark, sf_dir, name):
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_substring_dedup(spark, sf_dir):
    """Every passage that several documents hold: a row for each document that holds it."""
    return substrings.passages(_table(spark, sf_dir, "documents"))


def op2_language_model(spark, sf_dir):
    found = language_model.scores(_table(spark, sf_dir, "documents"), _remainder(7) != 2, stable=True)
    held_out = F.coalesce(_remainder(7) == 2, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def tokenizer(name="byte_bpe_multi_50k.tiktoken"):
    """(path, pattern) of a public vocabulary."""
    import public_tokenizers

    return str(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op3_byte_bpe(spark, sf_dir):
    return byte_bpe.encode_documents(_table(spark, sf_dir, "documents"), *tokenizer(), ids=False)


def op4_near_duplicates(spark, sf_dir):
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"))


def toxicity_model(spark, docs, sf_dir):
    return toxicity.train(docs, _table(spark, sf_dir, "labels"), _remainder(3) != 1)


def op5_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return found.select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_decontamination(spark, sf_dir):
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_url_filter(spark, sf_dir):
    return url_filter.verdicts(_table(spark, sf_dir, "pages"))


def op8_chat_format(spark, sf_dir):
    """Every turn with its repaired role and its share of the rendered conversation."""
    return chat.repaired(_table(spark, sf_dir, "conversations"))


def op9_fingerprints(spark, sf_dir):
    """Fingerprints, and the classes that bands and verification of fingerprints find."""
    return fingerprints.linked_fingerprints(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark, sf_dir):
    """Tokens of every document, counted in flat token files written from the whole table."""
    return token_counts.document_token_counts(_table(spark, sf_dir, "documents"), *tokenizer("byte_bpe_50k.tiktoken"))


def queries():
    own = (op1_substring_dedup, op2_language_model, op3_byte_bpe, op4_near_duplicates, op5_toxicity, op6_decontamination, op7_url_filter, op8_chat_format, op9_fingerprints, op10_token_counts)
    return {f.__name__: f for f in own}


#: The contract's columns that SQL can express stand in tests; the model's own score has no SQL.
def oracle_sql():
    return {}
