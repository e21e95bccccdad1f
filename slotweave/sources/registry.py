"""Forms stored once by their content: a table that grows by new forms only, safe for several writers.

A table is a folder of batches and of numbered commits that name them. What is not named in a commit does not count, so a
writer that fails leaves nothing behind that is read. A commit's number can be taken once; a writer that comes second reads
what the first has committed, leaves out forms that are there by now, and takes the next number.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "form_hash"


class Registry:
    """The table under a path of a file system whose create() makes a file once only (HDFS, local; not plain object stores)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._place = jvm.org.apache.hadoop.fs.Path
        self._files = self._place(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def commits(self) -> list[dict]:
        """The commits in order, each with its batch and number of forms."""
        folder = self._place(f"{self.path}/commits")
        if not self._files.exists(folder) or not len(self._files.listStatus(folder)):
            return []
        rows = self.spark.read.text(f"{self.path}/commits/*.json", wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value").collect()  # a row a commit
        return [{"number": int(name.removesuffix(".json")), **json.loads(value)} for name, value in sorted(rows) if value.strip()]

    def _commit(self, number: int, entry: dict) -> bool:
        """Take a number, unless another writer has it."""
        try:
            stream = self._files.create(self._place(f"{self.path}/commits/{number:012d}.json"), False)
        except Py4JJavaError:
            return False
        stream.write(json.dumps(entry).encode())
        stream.close()
        return True

    def read(self) -> DataFrame | None:
        """All committed rows with batch, their commit's number; None while there is none."""
        commits = self.commits()
        if not commits:
            return None
        rows = None
        for c in commits:
            batch = self.spark.read.parquet(f"{self.path}/batches/{c['batch']}").withColumn("batch", F.lit(c["number"]))
            rows = batch if rows is None else rows.unionByName(batch)
        return rows

    def add(self, forms: DataFrame, parse: Callable[[DataFrame], DataFrame], attempts: int = 20) -> dict:
        """Parse and add the forms (form_hash, ...) that the table does not hold; gives the commit.

        parse makes rows with form_hash of distinct new forms, each of which should give at least one. If another writer
        commits meanwhile, rows of forms that it added are left out of the batch, which is then written anew.
        """
        forms, seen = forms.dropDuplicates([KEY]), len(self.commits())
        known = self.read()
        new = forms if known is None else forms.join(known.select(KEY).distinct(), KEY, "left_anti")
        batch = uuid.uuid4().hex
        parse(new).write.parquet(f"{self.path}/batches/{batch}")
        for _ in range(attempts):
            commits = self.commits()
            rows = self.spark.read.parquet(f"{self.path}/batches/{batch}")
            if len(commits) > seen:
                there = self.spark.read.parquet(*[f"{self.path}/batches/{c['batch']}" for c in commits[seen:]]).select(KEY).distinct()
                batch = uuid.uuid4().hex
                rows.join(there, KEY, "left_anti").write.parquet(f"{self.path}/batches/{batch}")
                rows, seen = self.spark.read.parquet(f"{self.path}/batches/{batch}"), len(commits)
            entry = {"batch": batch, "forms": rows.select(KEY).distinct().count()}
            if self._commit(seen, entry):
                return {"number": seen, **entry}
        raise RuntimeError("other writers took every number")
