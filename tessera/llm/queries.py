"""Registered queries of the training-data operators: each runs its operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, htmltext, kdtree, langid, mixing, quality, simhash, substring, suffix, urlfilter
from .common import source_table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(source_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source_table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(source_table(spark, sf_dir, "pages"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(source_table(spark, sf_dir, "documents"), with_ids=False)


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(source_table(spark, sf_dir, "embeddings"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(source_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source_table(spark, sf_dir, "documents")
    judged = quality.judge(docs, quality.train(docs, source_table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(source_table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(source_table(spark, sf_dir, "pages"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(source_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_language_id, op3_url_filter, op4_byte_bpe, op5_exact_top_k,
        op6_substring_dedup, op7_quality_rules, op8_suffix_dedup, op9_html_text, op10_simhash_dedup,
    )
}

#: A straight SQL form of op6 for DuckDB: all windows, counted.
SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS n, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
p AS (SELECT n, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35),
k AS (SELECT n, i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM p),
r AS (SELECT n, i FROM k WHERE h IN (SELECT h FROM k GROUP BY h HAVING count(*) > 1)),
g AS (SELECT DISTINCT n, unnest(range(i, i + 35)) AS i FROM r),
l AS (SELECT n, list(i) AS gone FROM g GROUP BY n)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda x, j: NOT list_contains(gone, j)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN l USING (n)
"""

ORACLES: dict[str, str] = {
    "op1_mix_sources": mixing.ORACLE,
    "op3_url_filter": urlfilter.ORACLE,
    "op5_exact_top_k": kdtree.ORACLE,
    "op6_substring_dedup": SUBSTRING_SQL,
}
