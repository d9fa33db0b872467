"""A corpus pipeline: toxic documents go, near duplicates go, repeated passages are cut, contaminated documents go, and what stays is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's rows as Parquet in shared storage and
rereads them as the next one's docs. All but the last return the columns of documents.

Null and empty texts are neither toxic nor repeated nor contaminated and stay; rows without a doc_id are no one's copies and
stay; rows that share a doc_id are one document among near duplicates and keep their own texts; repeated rows count once;
texts are worked on whole; further columns of docs are handed on; an empty table gives an empty one at every stage.
"""

from __future__ import annotations

from evidentia.llm import byte_bpe, decontaminate, near_duplicates, substrings, toxicity
from evidentia.llm.common import shared_dir, small_batches
from evidentia.llm.queries import tokenizer, toxicity_model


def drop_toxic(spark, docs, sf_dir):
    """Without the documents that the toxicity model, fitted on these docs' training labels, scores at 0.7 or more."""
    small_batches(spark)
    return toxicity.without_toxic(docs, toxicity_model(spark, docs, sf_dir))


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group of near duplicates."""
    small_batches(spark)
    return near_duplicates.one_of_each(docs)


def cut_repeats(spark, docs, sf_dir):
    """Texts without later copies of passages that several documents hold; n_chars follows."""
    small_batches(spark)
    return substrings.without_repeats(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Without the documents that hold a benchmark item."""
    small_batches(spark)
    return decontaminate.without_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark, docs, sf_dir):
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of what stays."""
    small_batches(spark)
    return byte_bpe.encode_documents(docs, *tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: Lexicon learning, gear hashing and merge replay have no SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = shared_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{root}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
