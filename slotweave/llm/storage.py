"""Shared working tables: cut lineage by writing Parquet where every executor can read it."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.sources.store import shared_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/slotweave/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once and return a reader of it: later steps never recompute it, even when executors are lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(df: DataFrame) -> None:
    """Delete a stored table that nothing will read again."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextlib.contextmanager
def bloom_joins(spark: SparkSession) -> Iterator[None]:
    """While it lasts, Spark filters the large side of a selective shuffle join by a Bloom filter at any size."""
    key = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "0")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored_rows_of(rows: DataFrame, ids: DataFrame, key: str, name: str, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The rows whose key (a long) is among the distinct ids, after `then`, stored; a Bloom filter thins them before they
    are shuffled, and `then` finds them dealt by key."""
    ids = stored(ids.select(key), f"{name}-ids")
    every = F.col(key).between(-(1 << 63), (1 << 63) - 1)  # Spark builds the filter from a side that has a condition
    with bloom_joins(rows.sparkSession):
        return stored(then(rows.join(ids.filter(every), key)), name)


#: Rows of a few numbers that may be broadcast: tens of MB.
SMALL_ROWS = 500_000


def small(df: DataFrame, name: str, rows: int = SMALL_ROWS) -> DataFrame:
    """df stored, and marked for broadcast if it has at most `rows` rows; otherwise joins shuffle it."""
    df = stored(df, name)
    return F.broadcast(df) if df.count() <= rows else df  # the count comes from the files' footers


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores in front until no column has it in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out
