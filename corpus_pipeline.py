"""A corpus from raw documents to packed sequences, in five stages. Each stage's result is written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillstore.llm import mixing, packing, pii, quality_lm, simhash, similar
from quillstore.llm.queries import KEY, tokenizer_path
from quillstore.llm.util import shared_dir, ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity their language's limit allows."""
    ship(spark)
    return quality_lm.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of documents whose five-word shingles are similar to 0.8 or more: what SimHash links, checked, and what its bits miss."""
    ship(spark)
    return simhash.one_of_each(docs, near=similar.near_duplicates, by_simhash=True)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by pseudonyms."""
    ship(spark)
    return pii.pseudonymise_documents(docs, KEY)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, parts and repeats of them, as the source targets ask."""
    ship(spark)
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token sequences."""
    ship(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality_classifier", quality), ("simhash_near_dedup", near_duplicates), ("pii", personal_data), ("mixing", mix), ("packing", pack)]

#: The stages hash, model and tokenise: no SQL for them. tests/llm holds the near-duplicate stage against all pairs, the
#: model, pseudonyms and tokens against plain versions or round trips, and the chain against its stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
