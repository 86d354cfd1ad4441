"""The corpus pipeline: language ID, near-duplicate removal, decontamination, personal data, byte-pair encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
applies them to the whole table of documents, writing each stage's rows into the cluster's shared folder.
"""

from __future__ import annotations

from docframe.cluster import durable
from docframe.llm import bpe, decontaminate, langid, minhash, pii
from docframe.llm.vocab import vocabulary

#: Shingles of five words and a similarity of 0.8, for the near-duplicate stage.
SHINGLE, PERCENT = 5, 80


def language_id(spark, docs, sf_dir):
    return langid.stage(docs)


def near_dedup(spark, docs, sf_dir):
    return minhash.stage(docs, SHINGLE, PERCENT)


def decontamination(spark, docs, sf_dir):
    return decontaminate.stage(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark, docs, sf_dir):
    return pii.stage(docs)


def encoding(spark, docs, sf_dir):
    """The documents with their ids and decoded text."""
    return bpe.stage(docs, vocabulary())


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("bpe", encoding),
]
#: SQL can't express the language model, the transducers or the encoder.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs)
    return docs
