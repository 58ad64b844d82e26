"""A corpus pipeline of five operators: quality rules, near-duplicates, substring removal, source mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodetide.llm import byte_bpe, near_texts, quality_rules, source_mix, suffix_dedup
from nodetide.llm.common import cut, release, written

#: Every leaf gives at most one epoch here, so no document comes twice.
MIX = source_mix.MixPlan(max_epochs=1, percent=90)


def _columns(docs: DataFrame, names: list[str]) -> DataFrame:
    """`docs` with n_chars, where it has one, brought up to date."""
    if "n_chars" in names:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*names)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_texts.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _columns(suffix_dedup.cut_texts(docs), docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mix_documents(docs, MIX)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """The digest columns of each document that is left: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    return byte_bpe.digests(docs, vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality), ("simhash near-dedup", near_duplicates), ("suffix dedup", substrings), ("source mixing", mixing), ("byte bpe", encoding)]

#: SQL can't express the fingerprints and ids; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        since = written()
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        release(spark, since, keep=("stage-",))  # what only this stage needed
    return STAGES[-1][1](spark, docs, sf_dir)
