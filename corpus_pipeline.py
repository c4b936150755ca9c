"""The training-data pipeline over ``documents``: language ID, SimHash near-dedup, substring dedup, mixing to target
weights, byte-level BPE. Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.

Defined cases: null texts, and texts without a letter, go with the first stage; empty tables stay empty through all stages; of rows that repeat in doc_id and
text one stays at the second stage, rows without doc_id are rows like any other; texts of any length are worked on whole; other columns, of any name, are kept up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, langid, mixing, simhash, substring
from tessera.llm.common import Scratch, made, release


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay; ``und`` goes."""
    return langid.keep_identified(docs, langid.learn(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest doc_id stays. Candidates come from SimHash fingerprints by Golay keys, and from min-hash bands beyond
    their reach; links are verified (five-word shingles, Jaccard similarity of 0.8 or more)."""
    return simhash.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under repeated windows of 35 words go; all documents stay."""
    return substring.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is repeated, shortened or left out so that the mix takes of it the words its source's quota gives."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text of the mix, with digests of the ids and of the decoded bytes."""
    return bpe.encode_documents(docs, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("source_mix", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each from the table its predecessor wrote. What a stage leaves in the shared folder goes when its table is written."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = len(STAGES) - 1
    for i, (name, stage) in enumerate(STAGES):
        mark = made()
        docs = stage(spark, docs, sf_dir)
        if i < last:
            docs = scratch.table(docs, name)
            release(spark, mark)
            if i:
                scratch.drop(STAGES[i - 1][0])
    return docs


#: Cross-parsing, near-duplicate components and BPE have no SQL form; the tests hold each stage, and run(), against brute force on a small table.
ORACLE_SQL = None
