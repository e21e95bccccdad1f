"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Both models are bags of n-grams (tokens and pairs of neighbouring tokens) hashed to BUCKETS. A document's log
weight is the log ratio of its likelihood under the two; adding Gumbel noise and taking the k greatest keys
draws k documents without replacement in proportion to their weights. The raw model counts all documents. The
target model counts a bounded sample of labelled rows: the documents of good quality, at most TARGET_DOCS of
least hash. Only bucket counts (BUCKETS rows) and histogram counts of the keys reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import stored

BUCKETS = 10_000
TARGET_DOCS = 20_000
SMOOTHING = 1.0
SEED = 7
#: Keys are compared in steps of 1 / KEY_STEPS.
KEY_STEPS = 1 << 20
_BINS = 4096

#: 0: white space, 1: letters, digits, `_` and all beyond ASCII, 2: punctuation; a token is a run of one kind.
KIND = np.full(256, 2, np.uint8)
KIND[K.SPACE] = 0
KIND[128:] = 1
KIND[list(b"0123456789_ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = 1


def ngrams(block: K.Text) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of a block, and its text."""
    tokens = K.split_words(block, KIND)
    hashes, owner = K.word_hashes(block, tokens, K.CODE), tokens.owner()
    pairs, first = K.windows(hashes, tokens, 2)
    buckets = np.concatenate([hashes, pairs]) % np.uint64(BUCKETS)
    return buckets.astype(np.int64), np.concatenate([owner, owner[first]])


def target_ids(labels: DataFrame) -> DataFrame:
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_DOCS)


def log_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Per bucket the log of its probability under the target over that under the raw model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            target = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for block in K.texts(batch.column(0)):
                buckets, owner = ngrams(block)
                total[0] += np.bincount(buckets, minlength=BUCKETS)
                total[1] += np.bincount(buckets[target[block.at + owner]], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), *map(pa.array, total)], ["bucket", "raw", "target"])

    ids = F.broadcast(target_ids(labels).withColumn("target", F.lit(True)))  # at most TARGET_DOCS rows
    rows = docs.select("doc_id", "text").join(ids, "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    counts = rows.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    total = np.zeros((2, BUCKETS))
    for bucket, raw, target in counts.collect():
        total[:, bucket] = raw, target
    p = (total + SMOOTHING) / (total.sum(1, keepdims=True) + SMOOTHING * BUCKETS)
    return np.log(p[1]) - np.log(p[0])


def kth_greatest(rows: DataFrame, key: str, k: int) -> int | None:
    """The k-th greatest value of a long column, from counts of ever narrower bins; None if k < 1 or no row."""
    lo, hi, n = rows.agg(F.min(key), F.max(key), F.count(key)).first()
    if k < 1 or not n:
        return None
    if k >= n:
        return lo
    while lo < hi:
        width = (hi - lo) // _BINS + 1
        bins = rows.filter(F.col(key).between(lo, hi)).groupBy(F.floor((F.col(key) - lo) / F.lit(width)).alias("bin")).count()
        for b, count in sorted(bins.collect(), reverse=True):  # at most _BINS rows
            if k <= count:
                lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
                break
            k -= count
    return lo


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_grams, log_weight, key and kept, true for the k greatest keys.

    labels: doc_id and quality (1: good). k is the share of the rows that have an n-gram; by default the share of
    good ones among the labelled. log_weight is the sum over the whole text's n-grams. Null and empty texts have
    no n-gram and are not kept. Rows at the k-th key tie and are all kept, as are repeated rows together. Labels
    with null quality or id don't count; without good labels the target model is uniform and k is 0 unless share
    is given. Reruns agree: the noise is a hash of doc_id. An empty table gives no row; other columns are ignored.
    """
    if share is None:
        good, known = labels.agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)), F.count("quality")).first()
        share = good / known if known else 0.0
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ratios.value
        for batch in batches:
            n, w = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for block in K.texts(batch.column(1)):
                buckets, owner = ngrams(block)
                at = slice(block.at, block.at + len(block))
                n[at] = np.bincount(owner, minlength=len(block))
                w[at] = np.bincount(owner, r[buckets], minlength=len(block))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(w)], ["doc_id", "n_grams", "log_weight"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_grams long, log_weight double")
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(SEED)), 12).cast("double") + 0.5) / float(1 << 52)
    key = F.col("log_weight") - F.log(-F.log(uniform))
    rows = rows.withColumn("key", F.when(F.col("n_grams") > 0, F.floor(key * KEY_STEPS).cast("long")))
    rows = stored(rows, "weights")
    n = rows.filter("key IS NOT NULL").count()
    cut = kth_greatest(rows, "key", round(share * n))
    return rows.withColumn("kept", F.coalesce(F.col("key") >= F.lit(cut), F.lit(False)) if cut is not None else F.lit(False))
