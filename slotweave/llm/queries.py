"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 512)


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20, 64)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), 85)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def op6_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import shared_passages

    return shared_passages(table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixture import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op8_archive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .unigram import encode_texts

    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_identify_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify_languages

    return identify_languages(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"), 100, 100, 2000)


def op12_resample_to_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .postings import resample_to_target

    return resample_to_target(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20, 5, 42)


def op13_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .secret_scan import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_importance_resampling": op2_importance_resampling,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_quality_rules": op5_quality_rules,
    "op6_shared_passages": op6_shared_passages,
    "op7_mix_sources": op7_mix_sources,
    "op8_archive_pages": op8_archive_pages,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_identify_languages": op10_identify_languages,
    "op11_collocations": op11_collocations,
    "op12_resample_to_target": op12_resample_to_target,
    "op13_scan_secrets": op13_scan_secrets,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_top_k": oracles.TOP_K,
    "op4_near_duplicates": oracles.NEAR_DUPLICATES,
    "op7_mix_sources": oracles.MIXTURE,
    "op8_archive_pages": oracles.WARC,
    "op11_collocations": oracles.COLLOCATIONS,
    "op12_resample_to_target": oracles.RESAMPLING,
}
