"""Corpus pipeline: documents to token ids in five stages, each working on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.llm.mixture import mixed
from slotweave.llm.neardup import without_near_duplicates
from slotweave.llm.passages import shared_passages, without_passages
from slotweave.llm.quality import passing
from slotweave.llm.storage import small, stored
from slotweave.llm.unigram import encode_texts


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts have no word and go; null ids, languages and sources are no fault; repeated rows are judged alike;
    an empty table stays empty.
    """
    return passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates (five words, 0.8).

    Null and empty texts and null ids are linked with nothing and stay; of equal rows of one id one stays; an empty
    table stays empty.
    """
    return without_near_duplicates(docs, 80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that a document of smaller id has too.

    n_chars follows the text where it is cut; a document of which nothing is left goes. Null texts and null ids stay as
    they are; repeated rows are cut alike, of other texts of a repeated id only the least; an empty table stays empty.
    """
    found = stored(shared_passages(docs), "passages")
    ids = small(found.select("doc_id").distinct(), "cut-ids")
    cut = without_passages(docs.join(ids, "doc_id", "left_semi"), found)
    cut = cut.filter((F.col("text") != "") | F.col("text").isNull())
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.join(ids, "doc_id", "left_anti").unionByName(cut.select(*docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy of a document that the mix of sources takes, in the order of training.

    Documents without a word are not taken; null is a source of its own; equal rows of one id give one row at each of
    their positions, and a null id is an id like others; ties go by id; an empty table stays empty.
    """
    return mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the check that they decode to the text.

    Null and empty texts have no pieces; repeated rows and null ids give a row each, an empty table none.
    """
    return encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", passages),
    ("source_mixing", mixing),
    ("sentencepiece", encoding),
]

#: Robust fits, chained matches and segmentations have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
