"""Working tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); where it is unset, as in local tests, a new local one.

    Executors on other machines would not see a local folder, so there it is an error.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("slotweave.shared.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="slotweave-")
        spark.conf.set("slotweave.shared.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once and return a reader of it, so that later steps never compute it again."""
    path = f"{shared_dir(df.sparkSession)}/slotweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


#: Rows of a few short columns that may be broadcast.
SMALL_ROWS = 100_000


def small(df: DataFrame, name: str) -> DataFrame:
    """df stored, and marked for broadcast if it has at most SMALL_ROWS rows; joins shuffle it otherwise."""
    out = stored(df, name)
    return F.broadcast(out) if out.count() <= SMALL_ROWS else out


def release(df: DataFrame) -> None:
    """Delete a stored table that nothing will read again."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
