"""The queries of the operators of this subpackage, over whole tables, and their SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, divergence, html_template, licenses, merkle, negatives, quality, quotes, simhash, syncmers, token_counts, toxicity
from .common import table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
COUNTED = public_tokenizers.path("word_bpe_49k.json")
#: Tokens above which a document is over the limit.
LIMIT = 2048


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(quotes.quoting(table(spark, sf_dir, "conversations")), spark)


def op2_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit_pages(table(spark, sf_dir, "pages"), spark)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_fingerprints(table(spark, sf_dir, "documents"), spark)


def op5_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.recognise(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), spark)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), VOCABULARY, PATTERN)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(table(spark, sf_dir, "pages"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), COUNTED, LIMIT)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"), spark)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), spark)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quotation_linking,
        op2_merkle_audit,
        op3_benchmark_decontamination,
        op4_closed_syncmers,
        op5_license_sentences,
        op6_toxicity,
        op7_simhash_dedup,
        op8_byte_bpe,
        op9_quality,
        op10_template_extraction,
        op11_token_counts,
        op12_hard_negatives,
        op13_source_divergence,
    )
}
SQL = {"op1_quotation_linking": quotes.SQL, "op2_merkle_audit": merkle.SQL, "op5_license_sentences": licenses.sql(), "op12_hard_negatives": negatives.SQL, "op13_source_divergence": divergence.SQL}
