"""Corpus pipeline: documents -> stages of training-data operators, each written and read again.

``STAGES`` lists (name, function); every function takes (spark, docs, sf_dir) and returns a DataFrame.
All but the last return the columns of ``documents``: each one's decisions take effect by dropping or
rewriting documents. The last returns the pieces of the packed sequences with their token ids.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentlake.llm import best_fit_packing, jaccard_join, language_id, pseudonyms, quality_rules
from contentlake.llm.common import begin, table
from contentlake.llm.queries import PSEUDONYM_KEY
from contentlake.session import checkpoint_dir


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, or whose best language wins too narrowly, go. The
    dictionaries come from the documents' own language labels."""
    begin(spark)
    return language_id.filter_languages(docs, docs.select("text", "lang"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that fail the base rule or a certified cutoff go."""
    begin(spark)
    return quality_rules.filter_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join on five-word shingles at 0.8: of each group of linked documents the one with
    the smallest id stays."""
    begin(spark)
    return jaccard_join.keep_one(docs, num=80, den=100, shingle=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: every found value becomes its pseudonym; ``n_chars`` follows the text."""
    begin(spark)
    rows, found = pseudonyms.pseudonymize(docs, PSEUDONYM_KEY)
    return rows.drop(found).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of at most 4096 tokens, with the ids of every piece."""
    begin(spark)
    return best_fit_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True)


STAGES = [("language_id", languages), ("quality_rules", quality), ("jaccard_join", near_duplicates),
          ("pseudonyms", personal_data), ("packing", packing)]

#: Compression, learned cutoffs, keyed permutations and tokenizers are beyond SQL: the stages are
#: tested against brute-force versions in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    begin(spark)
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
