"""Text corpora as source tables, and tables written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.operators.extract import resolve_kind


def with_kind(docs: DataFrame, told: str | Column, path: str | Column) -> DataFrame:
    """kind (txt, md or hwpx; null with error UNKNOWN_KIND), as told or by the file's ending."""
    docs = docs.withColumn("kind", resolve_kind(told, path))
    return docs.withColumn("error", F.when(F.col("kind").isNull(), "UNKNOWN_KIND"))


def read_sources(spark: SparkSession, path: str, kind: str = "") -> DataFrame:
    """(doc_id, kind, text, error): a row per text file under path; the file's path is the id."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
    return with_kind(rows, F.lit(kind), "doc_id").select("doc_id", "kind", "text", "error")


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet", by: dict[str, list[str]] | None = None) -> None:
    """Each table under path/name, as parquet or json, partitioned by the columns given for it."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy(*(by or {}).get(name, [])).format(fmt).save(f"{path}/{name}")
