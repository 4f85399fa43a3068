"""A corpus pipeline of five operators. Each stage reads what the one before it kept and returns documents.

1. toxicity: documents that score as toxic go.
2. quality: documents that score as poor go.
3. near copies: of texts linked by a Jaccard similarity of 0.8 over five-word shingles (candidates by SimHash, MinHash
   and prefix filter, checked exactly) the document with the smallest id stays.
4. decontamination: documents that hold a benchmark item go.
5. bpe: the last stage; token counts and digests of each document left.

Models of the first two are fitted on labelled rows of the stage's own input (see SAMPLE in their modules).

Defined results: a null text is an empty one; documents without an id are kept or dropped by their text like any other,
and of equal near copies one row stays; two texts under one id are two documents; an empty table gives an empty result;
extra columns are kept up to the last stage, which returns ids and counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import bpe, decontaminate, near_copies, quality, queries, toxicity
from loomline.llm.common import discard, shared_dir, table, workspace

#: SQL has none of the models, automata and walks of these stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    score = toxicity.scorer(toxicity.train(docs, table(spark, sf_dir, "labels")))
    return docs.where(score(F.col("text")) < toxicity.THRESHOLD)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    score = quality.scorer(spark, quality.train(docs, table(spark, sf_dir, "labels")))
    return docs.where(score(F.col("text")) >= quality.THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs, spark)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_filter(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, queries.VOCABULARY, queries.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over documents; each result is written as Parquet to the shared folder and read again.

    Only the last result stays there: what a stage stashed is deleted with its end, its input once its output is written.
    """
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with workspace(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        if k:
            discard(spark, f"{at}/{k - 1}")
    return docs
