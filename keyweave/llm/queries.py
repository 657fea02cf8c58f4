"""The queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.llm import ann, byte_bpe, chat, langid, mixing, quality, sharding, simhash, url_filter, warc
from keyweave.llm._common import checkpointed, scratch

URL_RULES = (
    url_filter.Rule("block", "net/"),
    url_filter.Rule("allow", "example.net/en/"),
    url_filter.Rule("block", "example.com/de/"),
    url_filter.Rule("allow", "org/fr/"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), n_shards=24)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(_table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), radius=3)


def byte_bpe_digests(documents: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    ranks = byte_bpe.read_ranks(public_tokenizers.path(vocabulary))
    return byte_bpe.encode(documents, ranks, public_tokenizers.PATTERN, decoded=True, finish=byte_bpe.digest, finished=byte_bpe.DIGESTS)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe_digests(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):  # the archive goes when all of it has been read back
        read = warc.archive_and_read(_table(spark, sf_dir, "pages"), min_bytes=0)
        return checkpointed(read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.pair_conversations(_table(spark, sf_dir, "conversations"))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.array_join(s, "+")), ",")
    return pairs.withColumn("chosen_mask", spans("chosen_mask")).withColumn("rejected_mask", spans("rejected_mask"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, cap=2.0)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
