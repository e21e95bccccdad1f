"""Resampling towards a target distribution by inverted postings.

Features are the runs of 1 to 3 words of a text; a feature's bucket is the CRC-32 of its bytes modulo BUCKETS. Texts
are read once, in blocks of about BLOCK_BYTES; of every block and bucket one posting list is written: the places of the
block's texts that have the bucket and how often, both as byte gaps. The lists of both corpora are dealt to cells
of buckets, and co-grouped there with the counts of these buckets in both corpora, from which the cell computes
its own buckets' gains. Each cell emits what its lists add to every document of a block, and these are summed by block.

A bucket that a third of all features fall into has at most one posting a text, so a cell differs from others by a few
buckets' lists at most; cells are cut into parts by block so that none holds more than about PART_BYTES. Counts are summed
in the tasks before they are shuffled. The driver sees totals and BUCKETS rows at most.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .importance import kth_greatest
from .storage import release, stored

BUCKETS = 10_000
SIZES = 3
CELLS = 16
BLOCK_BYTES = 4 << 20
BLOCK_TEXTS = 1 << 16
PART_BYTES = 4 << 20
#: Words of a text whose features are made at a time.
SLICE_WORDS = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: 1: letters, digits and all beyond ASCII; a word is a run of them.
KIND = np.zeros(256, np.uint8)
KIND[128:] = 1
KIND[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = 1

_SHORT = 32
_BYTE = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
#: What eight zero bits make of the low byte of the register.
_STEP = _BYTE ^ _BYTE[0]


def _shift_table(crcs: np.ndarray) -> np.ndarray:
    """(4, 256) images of the bytes of a 32-bit number under the linear map that sends bit i to crcs[i]."""
    out = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for bit in range(8):
            out[k, (np.arange(256) >> bit & 1) == 1] ^= crcs[8 * k + bit]
    return out


@functools.cache
def _shifts() -> tuple[np.ndarray, np.ndarray]:
    """Tables that move a CRC past n further bytes: for each n < 2 * _SHORT, and for every power of two."""

    def past_byte(c: np.ndarray) -> np.ndarray:
        return _STEP[c & np.uint32(255)] ^ (c >> np.uint32(8))

    bits, some = np.uint32(1) << np.arange(32, dtype=np.uint32), []
    for _ in range(2 * _SHORT):
        some.append(_shift_table(bits))
        bits = past_byte(bits)
    powers = [some[1]]
    for _ in range(40):
        powers.append(_shift_table(_moved(_moved(np.uint32(1) << np.arange(32, dtype=np.uint32), powers[-1]), powers[-1])))
    return np.stack(some), np.stack(powers)


def _moved(c: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0, c & np.uint32(255)] ^ table[1, c >> np.uint32(8) & np.uint32(255)] ^ table[2, c >> np.uint32(16) & np.uint32(255)] ^ table[3, c >> np.uint32(24)]


def joined(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings one after the other, of which the second is `length` bytes long."""
    some, powers = _shifts()
    flat = some.ravel()
    at = np.minimum(length, 2 * _SHORT - 1).astype(np.int64) * 1024
    out = np.zeros(len(left), np.uint32)
    for k in range(4):
        out ^= flat[at + 256 * k + (left >> np.uint32(8 * k) & np.uint32(255))]
    far = np.flatnonzero(length >= 2 * _SHORT)
    if len(far):
        c, n = left[far], length[far]
        for bit in range(int(n.max()).bit_length()):
            c = np.where(n >> bit & 1 == 1, _moved(c, powers[bit]), c)
        out[far] = c
    return out ^ right


def word_crcs(data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of byte spans of data."""
    out = np.empty(len(starts), np.uint32)
    for i in np.flatnonzero(length > _SHORT):
        out[i] = zlib.crc32(data[starts[i] : starts[i] + length[i]])
    order = np.flatnonzero(length <= _SHORT)
    order = order[np.argsort(-length[order].astype(np.int8), kind="stable")]
    left = np.searchsorted(-length[order], -np.arange(_SHORT), side="left")  # words longer than each place
    register, begin = np.full(len(order), 0xFFFFFFFF, np.uint32), starts[order]
    for place in range(_SHORT):
        n = int(left[place])
        if not n:
            break
        r = register[:n]
        register[:n] = _STEP[(r ^ data[begin[:n] + place]) & np.uint32(255)] ^ (r >> np.uint32(8))
    out[order] = register ^ np.uint32(0xFFFFFFFF)
    return out


def features(block: K.Text) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, buckets, texts of the block) of all features, by size and slices of SLICE_WORDS words."""
    words = K.split_words(block, KIND)
    owner = words.owner()
    for i in range(0, len(owner), SLICE_WORDS):
        j = min(len(owner), i + SLICE_WORDS + SIZES - 1)  # a feature belongs to the slice of its first word
        low, high = words.starts[i], words.ends[j - 1]
        data = LOWER[block.data[low:high]]
        starts, length, own = words.starts[i:j] - low, words.ends[i:j] - words.starts[i:j], owner[i:j].astype(np.int64)
        single = word_crcs(data, starts, length)
        run, n = single, min(SLICE_WORDS, len(own))
        yield 1, single[:n] % np.uint32(BUCKETS), own[:n]
        for size in range(2, min(SIZES, len(own)) + 1):
            run = joined(_spaced(run[: len(own) - size + 1]), single[size - 1 :], length[size - 1 :])
            ok = np.flatnonzero(own[size - 1 :] == own[: len(own) - size + 1])
            ok = ok[ok < n]
            yield size, run[ok] % np.uint32(BUCKETS), own[ok]


def _spaced(c: np.ndarray) -> np.ndarray:
    """The CRC after one space more."""
    c = c ^ np.uint32(0xFFFFFFFF)
    return (_STEP[(c ^ np.uint32(32)) & np.uint32(255)] ^ (c >> np.uint32(8))) ^ np.uint32(0xFFFFFFFF)


def gaps(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 as bytes: 255 as often as it goes into the number, then the rest. Also the bytes of each."""
    more = values // 255
    ends = np.cumsum(more + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = values % 255
    return out, more + 1


def numbers(data: np.ndarray) -> np.ndarray:
    """What gaps() wrote."""
    ends = np.flatnonzero(data != 255)
    return np.diff(np.cumsum(data, dtype=np.int64)[ends], prepend=0)


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


ROWS = "corpus int, block long, bucket int, n long, n_texts int, bytes long, texts binary, counts binary, place int, doc_id long, n_words long, n_features long"
_NAMES = [part.split()[0] for part in ROWS.split(", ")]
_ARROW = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def _batch(n_rows: int, **columns: pa.Array | np.ndarray) -> pa.RecordBatch:
    arrays = [columns[name] if name in columns else pa.nulls(n_rows, kind) for name, kind in zip(_NAMES, _ARROW, strict=True)]
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, kind) for a, kind in zip(arrays, _ARROW, strict=True)], _NAMES)


class Block:
    """Features of the texts of a block until it is full."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.texts, self.bytes = 0, 0

    def add(self, block: K.Text) -> np.ndarray:
        """Takes the texts of a block; gives the words of each."""
        n_words = np.zeros(len(block), np.int64)
        for size, bucket, text in features(block):
            key, count = np.unique(bucket.astype(np.int64) << 32 | (text + self.texts), return_counts=True)
            self.keys.append(key)
            self.counts.append(count)
            if size == 1:
                n_words += np.bincount(text, minlength=len(block))
        self.texts += len(block)
        self.bytes += len(block.data)
        return n_words

    def lists(self, corpus: int, block: int) -> pa.RecordBatch:
        """Posting rows, one a bucket."""
        keys, counts = np.concatenate([*self.keys, np.zeros(0, np.int64)]), np.concatenate([*self.counts, np.zeros(0, np.int64)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        bucket, text = (keys >> 32).astype(np.int32), keys & 0xFFFFFFFF
        at = np.flatnonzero(np.diff(bucket, prepend=-1))  # the first posting of each list
        gap = np.diff(text, prepend=0)
        gap[at] = text[at]
        packed, bytes_of = zip(gaps(gap), gaps(counts - 1), strict=True)
        sizes = [np.add.reduceat(b, at) if len(at) else b for b in bytes_of]
        n_texts = np.diff(np.concatenate([at, [len(keys)]]))
        n = len(at)
        return _batch(n, corpus=np.full(n, corpus), block=np.full(n, block), bucket=bucket[at], n=np.add.reduceat(counts, at) if n else counts, n_texts=n_texts, bytes=sizes[0] + sizes[1], texts=_binary(packed[0], sizes[0]), counts=_binary(packed[1], sizes[1]))


def posting_rows(texts: DataFrame) -> DataFrame:
    """ROWS of texts (corpus, doc_id, text): a posting list for each block and bucket, and a row for each text (bucket null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, blocks, opened = TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            corpora = batch.column(0).to_numpy(zero_copy_only=False)
            for text in K.texts(batch.column(2)):
                # a union's batches hold one corpus each, but this holds for any order too
                for i in range(0, len(text)) if len(set(corpora[text.at : text.at + len(text)])) > 1 else [None]:
                    part = text if i is None else K.Text(text.at + i, text.data[text.offsets[i] : text.offsets[i + 1]], text.offsets[i : i + 2] - text.offsets[i])
                    corpus = int(corpora[part.at])
                    if corpus not in opened:
                        opened[corpus] = (task << 31 | blocks, Block())
                        blocks += 1
                    number, block = opened[corpus]
                    place = np.arange(block.texts, block.texts + len(part))
                    n = block.add(part)
                    every = sum(np.maximum(n - k, 0) for k in range(SIZES))
                    yield _batch(len(part), corpus=np.full(len(part), corpus), block=np.full(len(part), number), place=place, doc_id=batch.column(1).slice(part.at, len(part)), n_words=n, n_features=every)
                    if block.bytes >= BLOCK_BYTES or block.texts >= BLOCK_TEXTS:
                        yield block.lists(corpus, number)
                        del opened[corpus]
        for corpus, (number, block) in opened.items():
            yield block.lists(corpus, number)

    return texts.select("corpus", "doc_id", "text").mapInArrow(run, ROWS)


def gains(s: np.ndarray, t: np.ndarray, s_all: int, t_all: int) -> np.ndarray:
    """floor(1000 * ln of a bucket's share in the target over that in the raw texts), one added to each bucket."""
    ratio = ((t + 1.0) * (float(s_all) + BUCKETS)) / ((s + 1.0) * (float(t_all) + BUCKETS))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def contributions(lists: DataFrame, counts: DataFrame, s_all: int, t_all: int) -> DataFrame:
    """(block, weights): what the buckets of a cell add to each text of a block, a row for each cell and block.

    lists: block, bucket, n_texts, bytes, texts, counts; counts: bucket, s, t. A cell takes the buckets of one remainder
    and, where there is much, a part of the blocks.
    """
    total = lists.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    parts = -(-total // (CELLS * PART_BYTES)) or 1

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema([("block", pa.int64()), ("weights", pa.list_(pa.int64()))])
        if not left.num_rows:
            return out.empty_table()
        gain = np.zeros(BUCKETS, np.int64)
        bucket, s, t = (right.column(c).to_numpy() for c in ("bucket", "s", "t"))
        gain[bucket] = gains(s, t, s_all, t_all)
        n_texts, at = left.column("n_texts").to_numpy(), left.column("block").to_numpy()
        packed = [np.frombuffer(b"".join(left.column(c).to_pylist()), np.uint8) for c in ("texts", "counts")]
        gap, count = numbers(packed[0]), numbers(packed[1]) + 1
        begin = np.cumsum(n_texts) - n_texts
        place = np.cumsum(gap)
        place -= np.repeat(place[begin] - gap[begin], n_texts)
        blocks, which = np.unique(at, return_inverse=True)
        size = np.zeros(len(blocks), np.int64)
        np.maximum.at(size, which, place[begin + n_texts - 1] + 1)
        base = np.concatenate(([0], np.cumsum(size)))
        target = np.repeat(base[which], n_texts) + place
        added = np.repeat(gain[left.column("bucket").to_numpy()], n_texts) * count
        weights = np.bincount(target, added.astype(np.float64), int(base[-1]))  # integers far below 2 ** 53: exact
        return pa.Table.from_arrays([pa.array(blocks), pa.ListArray.from_arrays(base.astype(np.int32), weights.astype(np.int64))], schema=out)

    cell = F.pmod("bucket", F.lit(CELLS)).alias("cell")
    dealt = lists.select(cell, F.pmod(F.xxhash64("block"), F.lit(parts)).alias("part"), "block", "bucket", "n_texts", "texts", "counts")
    own = counts.select(cell, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), "bucket", "s", "t")
    return dealt.groupBy("cell", "part").cogroup(own.groupBy("cell", "part")).applyInArrow(run, "block long, weights array<long>")


def weighed(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_features and weight, the sum of its features' gains, stored.

    target: text. The gain of a bucket is floor(1000 * ln(((t + 1) * (S + BUCKETS)) / ((s + 1) * (T + BUCKETS)))) of its
    features s, t and all features S, T in docs and target.
    """
    some = docs.select(F.lit(0).alias("corpus"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    other = target.select(F.lit(1).alias("corpus"), F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(posting_rows(some.unionByName(other)), "postings")
    lists = rows.filter("bucket IS NOT NULL")
    of = lambda corpus: F.sum(F.when(F.col("corpus") == corpus, F.col("n")).otherwise(0))
    counts = stored(lists.groupBy("bucket").agg(of(0).alias("s"), of(1).alias("t")), "bucket-counts")
    s_all, t_all = counts.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    parts = contributions(lists.filter("corpus = 0"), counts, s_all, t_all)
    sums = parts.select("block", F.posexplode("weights").alias("place", "w")).groupBy("block", "place").agg(F.sum("w").alias("weight"))
    own = rows.filter("bucket IS NULL AND corpus = 0").select("block", "place", "doc_id", "n_words", "n_features")
    out = stored(own.join(sums, ["block", "place"], "left").select("doc_id", "n_words", "n_features", F.coalesce("weight", F.lit(0)).alias("weight")), "weighed")
    release(rows)
    release(counts)
    return out


def noise(doc_id: str | Column, seed: int = 42) -> Column:
    """floor(-1000 * ln(-ln u)), with u from the first 8 hex digits of the SHA-256 of `seed:doc_id` (null: empty)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """rows (score, doc_id, ...) with rank: 1 to k by score downwards, then doc_id; null beyond.

    Rows are dealt by ranges of the order; a row's rank is its place in the range after the rows of ranges before.
    """
    cut = kth_greatest(rows, "score", k) if k > 0 else None
    none = F.lit(None).cast("long").alias("rank")
    if cut is None:
        return rows.withColumn("rank", none)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    top = stored(rows.filter(F.col("score") >= cut).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "drawn")
    sizes = top.groupBy("_range").agg(F.count("*").alias("n"))
    before = F.broadcast(sizes.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("before")))  # a row a range
    rank = F.col("before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    top = top.join(before, "_range").withColumn("rank", rank.cast("long"))
    top = top.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank"))).drop("_range", "before")
    return top.unionByName(rows.filter(F.coalesce(F.col("score") < cut, F.lit(True))).withColumn("rank", none))


def resample_to_target(docs: DataFrame, target: DataFrame, least_words: int = 20, percent: int = 5, seed: int = 42) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_features, weight, score and rank (all long).

    target: text. score is weight and a Gumbel noise of doc_id; of the N rows with at least least_words words the
    floor(percent * N / 100) of highest scores are drawn and ranked, ties by smaller doc_id; other rows have no rank. Words
    are lower-cased (A-Z only) runs of letters, digits and characters beyond ASCII of the whole text.

    Null and empty texts have no feature and weight 0. A null doc_id counts as empty text in the noise and stands first among
    ties. Rows that repeat an id each count, and are ranked one after the other. Very long texts are a block of
    their own, counted by slices. Without target texts t and T are 0; an empty table gives no row. Other columns are
    ignored.
    """
    rows = weighed(docs, target)
    rows = rows.withColumn("score", F.col("weight") + noise("doc_id", seed))
    long_enough = F.col("n_words") >= least_words
    n = rows.filter(long_enough).count()
    some = ranked(rows.filter(long_enough), percent * n // 100)
    rest = rows.filter(~long_enough).withColumn("rank", F.lit(None).cast("long"))
    return some.unionByName(rest)
