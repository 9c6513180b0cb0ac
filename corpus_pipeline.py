"""From raw documents to packed sequences. Each stage's result is written as Parquet and is the next one's input.

Defined cases: a null text is an empty one, is not toxic unless the model says so of empty texts, and is packed as its end alone; null ids stay, as rows of their own; of repeated ids each row
counts; equal texts and near copies leave one row, that with the largest and that with the smallest id; columns of documents other than id and text go along unchanged
up to the last stage, whatever their names; an empty table, or one without labels, gives an empty result or one of which nothing is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import exact_dedup, packing, pii, simhash, toxicity
from textloom.llm.common import store
from textloom.llm.queries import table, tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles and a similarity of 0.8, confirmed on the sets of shingles; one document of each group stays."""
    return simhash.survivors(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: Hashes, tokenizers and fitted models have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
