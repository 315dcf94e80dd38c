"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents.  Every stage's rows are written as Parquet to the shared folder and
read again, so a lost executor costs one stage at most.

What holds for all stages: null ids, null and empty texts and repeated rows are rows like any other
(each stage says what becomes of them), ties are settled by doc_id, columns that aren't named here are
carried along whatever they are called, and no rows give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm import bpe, decontaminate, near_dup, pii, quality
from parcelflow.llm.storage import stored, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    Null and empty texts have zero statistics and are scored as such; equal texts share their fate.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each near-duplicate class.

    Of repeated rows one stays; rows of one id with different texts stay; null and empty texts are equal
    texts; rows with a null id stay.
    """
    return near_dup.keep_one_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item leaks; null and empty texts hold none."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text, null texts stay null."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*(F.col(f"`{c}`") for c in docs.columns))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document; a null or empty text has no ids."""
    return bpe.encode_docs(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("decontamination", without_benchmark), ("personal_data", without_personal_data), ("byte_bpe", token_ids)]
#: No stage can be put in SQL: tests/llm/test_pipeline.py holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", spread=True)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
