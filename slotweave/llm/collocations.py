"""Phrase collocations by contiguous pattern growth.

Texts are cut at punctuation and line ends into pieces, and these into words; a phrase lies within a piece. Frequent
words and frequent pairs are counted first, summed in the tasks before they are shuffled. Every frequent pair is then a
prefix: each of its occurrences that can go on (the next words and pairs are frequent too) becomes a pointer to the
words that follow, equal pointers are counted together, and all pointers of a prefix go to one task, which extends it
to the right depth-first, projecting the pointers on each frequent extension. A prefix with more than HOT_POINTERS
occurrences is dealt by its third word to several tasks; each extension still is in one of them.

Words are numbered by the place of their 64-bit hash (with the language in it) among the frequent ones. The frequent words
and pairs that let tasks leave out hopeless occurrences are broadcast only up to FILTER_ROWS; beyond, words count by
hash and nothing is left out early, with the same result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .postings import LOWER
from .storage import release, small, stored

LONGEST = 5
FILTER_ROWS = 4_000_000
HOT_POINTERS = 1_000_000
BLOCK_BYTES = 4 << 20
#: Parts in which each language's first rows are found before they meet.
PARTS = 64

#: What ends a piece, and what parts words in it.
ENDS = np.zeros(256, bool)
ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
KIND = (~ENDS).astype(np.uint8)
KIND[[0x20, 0x09]] = 0

WORD_COLUMNS = [f"w{i}" for i in range(1, LONGEST + 1)]


@functools.lru_cache(4096)
def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _hashes(block: K.Text, words: K.Words, owner: np.ndarray, langs: pa.DictionaryArray) -> np.ndarray:
    """63 bits for each word and its language."""
    salts = np.array([_salt(x) for x in langs.dictionary.to_pylist()], np.uint64)
    own = salts[langs.indices.to_numpy()[block.at + owner]]
    return (K.mix(K.word_hashes(block, words) + own) >> np.uint64(1)).astype(np.int64)


def _langs(column: pa.Array) -> pa.DictionaryArray:
    return pc.fill_null(column, "und").dictionary_encode()


def _strings(block: K.Text, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The lower-cased (A-Z) spans of a block."""
    length = ends - starts
    offsets = np.concatenate(([0], np.cumsum(length)))
    inside = np.arange(offsets[-1]) - np.repeat(offsets[:-1], length)
    data = LOWER[block.data[np.repeat(starts, length) + inside]]
    return pa.Array.from_buffers(pa.large_string(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.string())


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of docs (lang, text), stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = _langs(batch.column(0))
            for block in K.texts(batch.column(1), BLOCK_BYTES):
                words = K.split_words(block, KIND)
                owner = words.owner()
                _, first, n = np.unique(_hashes(block, words, owner, langs), return_index=True, return_counts=True)
                which = langs.take(pa.array(block.at + owner[first])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([which, _strings(block, words.starts[first], words.ends[first]), pa.array(n)], ["lang", "word", "n"])

    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, "lang string, word string, n long")
    return stored(rows.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")


class Filter:
    """Frequent words by hash, and frequent pairs by number with whether they are hot; None where there are too many."""

    def __init__(self, words: np.ndarray | None, pairs: np.ndarray | None = None, hot: np.ndarray | None = None):
        self.words, self.pairs, self.hot = words, pairs, hot

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 where it is not frequent."""
        if self.words is None:
            return hashes
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)

    def follows(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether pairs of frequent words may be frequent, and whether their pointers are dealt by the third word."""
        if self.pairs is None:
            return np.ones(len(a), bool), np.ones(len(a), bool)
        if not len(self.pairs):
            return np.zeros(len(a), bool), np.zeros(len(a), bool)
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return self.pairs[at] == key, self.hot[at]


def _distinct(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows and how often each occurs."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    if not len(order):
        return columns, order
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.diff(np.append(at, len(order)))


def _numbered(batch: pa.RecordBatch, frequent: Filter) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each block its words' numbers, and whether a word and the next stand in one piece, both frequent."""
    langs = _langs(batch.column(0))
    for block in K.texts(batch.column(1), BLOCK_BYTES):
        words = K.split_words(block, KIND)
        owner = words.owner()
        if len(owner) < 2:
            continue
        number = frequent.numbers(_hashes(block, words, owner, langs))
        piece = np.cumsum(ENDS[block.data], dtype=np.int64)[words.starts]
        yield number, (owner[1:] == owner[:-1]) & (piece[1:] == piece[:-1]) & (number[1:] >= 0) & (number[:-1] >= 0)


def pair_counts(docs: DataFrame, frequent: Filter, least: int) -> DataFrame:
    """(w1, w2, a): pairs of frequent words that occur `least` times or more, stored."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, together in _numbered(batch, shared.value):
                at = np.flatnonzero(together)
                columns, n = _distinct([number[at], number[at + 1]])
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(n)], ["w1", "w2", "a"])

    rows = docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, "w1 long, w2 long, a long")
    return stored(rows.groupBy("w1", "w2").agg(F.sum("a").alias("a")).filter(F.col("a") >= least), "pairs")


def pointers(docs: DataFrame, frequent: Filter) -> DataFrame:
    """(w1..w5, deal, n): each frequent pair's occurrences with the words that follow, as far as words and pairs are
    frequent (-1 beyond), at least one; deal is the third word of a hot pair, else -1."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, together in _numbered(batch, shared.value):
                pair = np.flatnonzero(together)
                ok, hot = shared.value.follows(number[pair], number[pair + 1])
                goes, deals = np.zeros(len(number) + LONGEST, bool), np.zeros(len(number) + LONGEST, bool)
                goes[pair], deals[pair] = ok, hot
                at = np.flatnonzero(goes[:-1] & goes[1:])  # three words at least
                columns, on = [number[at], number[at + 1], number[at + 2]], np.ones(len(at), bool)
                for k in range(3, LONGEST):
                    on = on & goes[at + k - 1]
                    columns.append(np.where(on, number[np.minimum(at + k, len(number) - 1)], -1))
                columns.append(np.where(deals[at], columns[2], -1))
                columns, n = _distinct(columns)
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(n)], [*WORD_COLUMNS, "deal", "n"])

    rows = docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, f"{', '.join(f'{c} long' for c in WORD_COLUMNS)}, deal long, n long")
    return rows.groupBy(*WORD_COLUMNS, "deal").agg(F.sum("n").alias("n"))


class Growth:
    """Depth-first growth of prefixes over sorted pointers."""

    def __init__(self, columns: list[np.ndarray], n: np.ndarray, least: int):
        self.columns, self.n, self.least = columns, n, least
        self.found: list[tuple[list[int], int]] = []

    def extend(self, prefix: list[int], low: int, high: int) -> None:
        """Finds the frequent phrases that begin with prefix, whose pointers are the rows low to high."""
        depth = len(prefix)
        following = self.columns[depth][low:high]
        cut = np.flatnonzero(following[1:] != following[:-1]) + 1
        begin = np.concatenate(([0], cut))
        counts = np.add.reduceat(self.n[low:high], begin)
        end = np.append(cut, high - low)
        for i in np.flatnonzero((counts >= self.least) & (following[begin] >= 0)):
            longer = [*prefix, int(following[begin[i]])]
            self.found.append((longer, int(counts[i])))
            if depth + 1 < LONGEST:
                self.extend(longer, low + int(begin[i]), low + int(end[i]))


def grown(prefixes: DataFrame, least: int) -> DataFrame:
    """(p, a): the frequent phrases of three words or more, p their word numbers, from pointers()."""

    def grow(parts: list[pa.Table]) -> pa.RecordBatch:
        rows = pa.concat_tables(parts)
        columns, n = [rows.column(c).to_numpy() for c in WORD_COLUMNS], rows.column("n").to_numpy()
        growth = Growth(columns, n, least)
        begin = np.flatnonzero((np.diff(columns[0], prepend=-2) != 0) | (np.diff(columns[1], prepend=-2) != 0))
        end = np.append(begin[1:], len(n))
        for i in np.flatnonzero(np.add.reduceat(n, begin) >= least):
            growth.extend([int(columns[0][begin[i]]), int(columns[1][begin[i]])], int(begin[i]), int(end[i]))
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in growth.found], pa.list_(pa.int64())), pa.array([a for _, a in growth.found], pa.int64())], ["p", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # the last prefix so far, which may go on in the next batch
        for batch in batches:
            rows = pa.table(batch)
            if not rows.num_rows:
                continue
            a, b = (rows.column(c).to_numpy() for c in ("w1", "w2"))
            new = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            last = (held[-1].column("w1")[-1].as_py(), held[-1].column("w2")[-1].as_py()) if held else None
            if held and last != (a[0], b[0]):
                yield grow(held)
                held = []
            if len(new):
                yield grow([*held, rows.slice(0, int(new[-1]))])
                held = [rows.slice(int(new[-1]))]
            else:
                held.append(rows)
        if held:
            yield grow(held)

    return prefixes.repartition("w1", "w2", "deal").sortWithinPartitions(*WORD_COLUMNS).mapInArrow(run, "p array<long>, a long")


def _with_hash(words: DataFrame) -> DataFrame:
    """words (lang, word, n) with h, the hash that tasks know a word by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = _langs(batch.column(0))
            for block in K.texts(batch.column(1), BLOCK_BYTES):
                one = K.Words(block.offsets[:-1], block.offsets[1:], np.arange(len(block) + 1))
                h = _hashes(block, one, np.arange(len(block)), langs)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(block.at, len(block)) for k in range(3)), pa.array(h)], ["lang", "word", "n", "h"])

    return words.select("lang", "word", "n").mapInArrow(run, "lang string, word string, n long, h long")


def _array(df: DataFrame, *names: str) -> list[np.ndarray] | None:
    """Columns of a table of at most FILTER_ROWS rows; None if it has more."""
    if df.count() > FILTER_ROWS:
        return None
    rows = df.select(*names).toArrow()
    return [rows.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in names]


def phrases(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words (number, lang, word, f), totals (lang, n), candidates (p, a)), all stored.

    candidates: phrases of 2 to LONGEST words, as arrays of word numbers, that occur `least` times or more.
    """
    counts = word_counts(docs)
    totals = stored(counts.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    words = stored(_with_hash(counts.filter(F.col("n") >= least)), "frequent")
    if words.select("h").distinct().count() != words.count():
        raise ValueError("two frequent words have one hash")
    known = _array(words, "h")
    frequent = Filter(None if known is None else np.sort(known[0]))
    sorted_hashes = docs.sparkSession.sparkContext.broadcast(frequent)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted_hashes.value.numbers(batch.column(3).to_numpy())), *batch.columns[:3]], ["number", "lang", "word", "f"])

    numbered = small(words.mapInArrow(number, "number long, lang string, word string, f long"), "numbered")
    pairs = pair_counts(docs, frequent, least)
    if frequent.words is not None and (found := _array(pairs, "w1", "w2", "a")) is not None:
        key = found[0] << 32 | found[1]
        order = np.argsort(key)
        frequent = Filter(frequent.words, key[order], found[2][order] > HOT_POINTERS)
    longer = grown(pointers(docs, frequent), least)
    candidates = stored(pairs.select(F.array("w1", "w2").alias("p"), "a").unionByName(longer), "candidates")
    for df in (counts, words, pairs):
        release(df)
    return numbered, totals, candidates


def collocations(docs: DataFrame, least: int = 100, share: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of docs (lang, text): each language's `top` phrases by score.

    Texts are lower-cased (A-Z), cut at `[.,;:!?]` and line ends into pieces and at spaces and tabs into words. A
    candidate is a phrase of 2 to 5 words of a piece with a >= least occurrences, overlapping ones included. Of its
    cuts into two parts with l and r occurrences the one of lowest score floor(1000 * a * n / (l * r)) counts, n being all the
    language's words; ties to the shortest first part. A candidate inside a longer one with 100 * f >= share * a is left
    out. Order: score and a downwards, phrase.

    A null lang is `und`; null and empty texts have no word; texts are cut whole, however long; repeated rows count as
    often as they stand; an empty table gives no row; other columns are ignored.
    """
    words, totals, candidates = phrases(docs, least)
    one = small(candidates.unionByName(words.select(F.array("number").alias("p"), F.col("f").alias("a"))), "phrases")
    size = F.size("p")
    longer = candidates.filter(size > 2).select("a", F.explode(F.array(F.slice("p", F.lit(1), size - 1), F.slice("p", F.lit(2), size - 1))).alias("p"))
    # A phrase's counts never grow with its length, so that of all longer ones those of one word more decide.
    inside = small(longer.groupBy("p").agg(F.max("a").alias("f")), "inside")
    kept = candidates.join(inside, "p", "left").filter(F.coalesce(100 * F.col("f") < share * F.col("a"), F.lit(True))).select("p", "a")
    lang = words.select(F.col("number").alias("first"), "lang").join(F.broadcast(totals), "lang")  # a row a language
    kept = kept.withColumn("first", F.get("p", F.lit(0))).join(lang, "first")

    cuts = kept.select("p", "a", "lang", "n", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("p", F.lit(1), F.col("k")), "right": F.slice("p", F.col("k") + 1, size - F.col("k"))})
    part = lambda name, count: one.select(F.col("p").alias(name), F.col("a").alias(count))
    cuts = cuts.join(part("left", "l"), "left").join(part("right", "r"), "right")
    # Decimals hold the products exactly: a * n and l * r up to 36 digits, a thousand times that up to 38.
    score = F.expr("(1000 * (cast(a AS decimal(17, 0)) * cast(n AS decimal(17, 0)))) div (cast(l AS decimal(18, 0)) * cast(r AS decimal(18, 0)))")
    best = cuts.groupBy("p", "a", "lang", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    named = best.select("p", F.posexplode("p").alias("i", "number")).join(words.select("number", "word"), "number")
    named = named.groupBy("p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = best.join(named, "p").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part_of = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    rows = rows.withColumn("part", part_of).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
