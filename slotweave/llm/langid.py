"""Language identification by cross-parsing entropy.

Per language a suffix automaton of labelled text accepts exactly that text's substrings. Only letters count: texts
are lower-cased, and whatever stands between letters is one space, so that signs and numbers, which no language owns,
decide nothing. A text is parsed against each automaton into phrases, each the longest match from where the last one
ended. Longer samples give longer matches, so the estimate of the cross-entropy is phrases * log2(length of the
language's sample) for each symbol parsed, and the language of the least wins. Texts are parsed whole, in stretches of
STRETCH symbols that each start a phrase, so that thousands of stretches advance together, one numpy step per symbol; the
bound on the extra phrases (one a stretch) is the same for every language.

The automata are fitted on a bounded sample of the labelled rows, for every language with any: of its SAMPLE_DOCS
documents of least hash the first ones whose characters together stay within SAMPLE_CHARS, of which a text gives at most its
first DOC_CHARS. Transitions are kept in a hash table over (state, character), so any number of different characters is told apart.
Each worker builds the automata from that sample; a language takes about 8 MB there.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import small

SAMPLE_DOCS = 256
SAMPLE_CHARS = 120_000
DOC_CHARS = 15_000
STRETCH = 256
#: Symbols parsed together.
LANES = 1 << 20
_HASH = np.uint64(0x9E3779B97F4A7C15)


class Transitions:
    """An automaton's transitions by (state, symbol), in an open hash table; -1 where no substring goes on."""

    def __init__(self, nxt: list[dict[int, int]], n_symbols: int):
        self.n_symbols = n_symbols
        keys = np.array([state * n_symbols + c for state, out in enumerate(nxt) for c in out], np.int64)
        values = np.array([to for out in nxt for to in out.values()], np.int32)
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            left = left[np.argsort(slot[left], kind="stable")]
            first = np.ones(len(left), bool)
            first[1:] = slot[left][1:] != slot[left][:-1]
            put = left[first & (self.keys[slot[left]] < 0)]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask
        self.start = np.full(n_symbols, -1, np.int64)
        for c, to in nxt[0].items():
            self.start[c] = to

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _HASH) >> self.shift).astype(np.int64)

    def __call__(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = state * self.n_symbols + symbol
        slot = self._slot(key)
        held = self.keys[slot]
        other = np.flatnonzero((held != key) & (held >= 0))
        while len(other):
            slot[other] = (slot[other] + 1) & self.mask
            held[other] = self.keys[slot[other]]
            other = other[(held[other] != key[other]) & (held[other] >= 0)]
        return self.values[slot]


@dataclass
class Model:
    langs: list[str]
    symbol: np.ndarray  # of each code point; 0: one that the sample does not hold
    step: list[Transitions]
    bits: np.ndarray  # log2 of the length of each language's sample


def suffix_automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the least automaton of all substrings of text; state 0 is its start."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


@functools.cache
def _is_letter() -> np.ndarray:
    """Of each code point whether it is a letter, or a mark on one."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])


def letters(text: str) -> np.ndarray:
    """Code points of a text's letters, lower-cased; one space for all that stands between two words."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _is_letter()[points]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first of what follows a letter
    return np.where(is_letter, points, np.uint32(32))[keep]


def fit(sample: dict[str, list[str]]) -> Model:
    """Automata of the sampled texts of each language."""
    joined = {lang: letters("\n".join(texts)) for lang, texts in sorted(sample.items())}
    joined = {lang: text for lang, text in joined.items() if len(text)}
    symbol = np.zeros(0x110000, np.int64)
    known = np.unique(np.concatenate([*joined.values(), np.zeros(0, np.uint32)]))
    symbol[known] = np.arange(1, len(known) + 1)
    steps = [Transitions(suffix_automaton(symbol[text]), len(known) + 1) for text in joined.values()]
    return Model(list(joined), symbol, steps, np.log2([len(text) + 1 for text in joined.values()]))


@functools.lru_cache(2)
def model_of(sample: tuple[tuple[str, tuple[str, ...]], ...]) -> Model:
    """The model of a sample, built once in each worker process."""
    return fit({lang: list(texts) for lang, texts in sample})


def phrases(model: Model, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of phrases of each text (rows) under each language (columns)."""
    n_texts, n_langs = len(offsets) - 1, len(model.langs)
    out = np.zeros((n_texts, n_langs), np.int64)
    count = -(-np.diff(offsets) // STRETCH)
    owner = np.repeat(np.arange(n_texts), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    begin = offsets[owner] + nth * STRETCH
    length = np.minimum(STRETCH, offsets[owner + 1] - begin)
    order = np.argsort(-length, kind="stable")
    owner, begin, length = owner[order], begin[order], length[order]
    for k, step in enumerate(model.step):
        again = np.maximum(step.start, 0)  # a new phrase's first symbol, known or not
        state = np.zeros(len(owner), np.int64)
        n = (length > 0).astype(np.int64)
        live = len(owner)
        for i in range(int(length[0]) if len(length) else 0):
            while live and length[live - 1] <= i:
                live -= 1
            s = symbols[begin[:live] + i]
            to = step(state[:live], s)
            ended = to < 0
            if i:  # at the root: the last symbol was a phrase of its own, unknown to this language
                n[:live] += ended | (state[:live] == 0)
            state[:live] = np.where(ended, again[s], to)
        np.add.at(out[:, k], owner, n)
    return out


def predict(model: Model, texts: list[str | None]) -> Iterator[tuple[str, float]]:
    """Language and score of each text, in order."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= LANES):
            size += len(texts[j] or "")
            j += 1
        points = [letters(t or "") for t in texts[i:j]]
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in points]))).astype(np.int64)
        counts = phrases(model, model.symbol[np.concatenate(points)], offsets)
        for t, c, n in zip(texts[i:j], counts, np.diff(offsets), strict=True):
            if not model.langs or not t or not any(map(str.isalpha, t)):
                yield "und", 0.0
                continue
            entropy = c * model.bits / max(1, n)
            best, least = model.langs[int(np.argmin(entropy))], np.sort(entropy)
            yield best, 1.0 if len(least) == 1 else float(least[1] / (least[0] + least[1]))
        i = j


def training_sample(docs: DataFrame) -> dict[str, list[str]]:
    """Per language texts, cut at DOC_CHARS, of at most SAMPLE_CHARS characters together.

    Ids are ranked within parts of a language before the parts meet, and only the chosen texts are read.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    keyed = labelled.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"))
    least = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy("h", "doc_id")) <= SAMPLE_DOCS
    keyed = keyed.withColumn("part", F.pmod("h", F.lit(16))).withColumn("ok", least("part")).filter("ok")
    chosen = keyed.withColumn("ok", least()).filter("ok").select("lang", "doc_id").distinct()  # SAMPLE_DOCS ids a language
    chosen = small(chosen, "labelled-sample")
    rows = labelled.join(chosen, ["lang", "doc_id"], "left_semi").select("lang", F.xxhash64("doc_id").alias("h"), F.substring("text", 1, DOC_CHARS).alias("text"))
    rows = rows.withColumn("upto", F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("h", "text").rowsBetween(Window.unboundedPreceding, 0)))
    out: dict[str, list[str]] = {}
    for lang, _, text in sorted(rows.filter(F.col("upto") <= SAMPLE_CHARS).select("lang", "h", "text").collect()):
        out.setdefault(lang, []).append(text)
    return out


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def identify_languages(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text, lang): doc_id, held_out, lang_pred and score.

    Labelled rows are those with a lang, a text and an id that are not held out (crc32 of the id as text, mod 5,
    is 0); only they are learned from, and lang is read for nothing else. A text is predicted whole, however long; a null
    text, or one without a letter, is `und` with score 0, as is any text when nothing was learned. score is
    the runner-up's entropy as a share of both: 0.5 for a tie (the smaller lang wins), towards 1 when clear. A
    null doc_id is not held out. Repeated rows give a row each, an empty table none; other columns are ignored.
    """
    sample = docs.sparkSession.sparkContext.broadcast(tuple(sorted((k, tuple(v)) for k, v in training_sample(docs).items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(sample.value)
        for batch in batches:
            found = list(predict(m, batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
