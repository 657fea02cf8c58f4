"""From documents to token ids in five stages; each works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import ExitStack

from pyspark.sql import DataFrame, SparkSession

from keyweave.llm import langid, mixing, quality, simhash
from keyweave.llm._common import remove_shared, scratch, shared_path
from keyweave.llm.queries import byte_bpe_digests


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language, or clearly of another than the declared one, go."""
    return langid.keep_identified(docs)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside the fences of their language and source go."""
    return quality.keep_quality(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose five-word shingles are alike to 0.8 or more, the document with the least id stays."""
    return simhash.keep_one_of_each(docs, words_each=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, or go, as their source's target asks."""
    return mixing.repeat_documents(docs, weights=(5, 2, 1), share=1.5, cap=2.0)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of digests per document and repetition: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return byte_bpe_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_languages),
    ("quality_rules", apply_quality_rules),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode_texts),
]

#: SQL can express neither the kernels nor the components nor the merges; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result is written once to the shared folder, from where the next one reads it; then it goes."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path, after = shared_path(spark, name), ExitStack()
        if before:
            after.callback(remove_shared, spark, before)
        with after, scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs, before = spark.read.schema(made.schema).parquet(path), path
    return docs
