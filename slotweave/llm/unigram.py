"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with scores.

The pieces and their scores come from a .model file; nothing is trained. A file of merges has ranks for scores; they
are turned to log scores by Zipf's law (see log_scores). White space is written as the
marker U+2581, one marker is put in front of a text, and no other normalisation takes place. Characters that no
single piece covers cost the least score less UNKNOWN_PENALTY and become byte pieces.

No piece holds a marker after another character, so a best segmentation never crosses from a word to the
marker before the next, and words are segmented once per block of texts, all words together: the Viterbi
recursion advances one byte at a time over arrays of words, following the double array in numpy.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN_PENALTY = 10.0
#: Of Zipf's law: the probability of the piece of rank r is in proportion to 1 / (r + ZIPF).
ZIPF = 20
#: Words of more bytes are segmented one by one.
LONG_WORD = 1024
#: Characters of a block of texts; words of one width class segmented together.
BLOCK_CHARS = 4 << 20
LANES = 1 << 16
TABLE_WORDS = 600_000

_MARK = "▁"
_WORD = re.compile(" *[^ ]+| +")
_LENGTH = np.ones(256, np.int64)  # bytes of a character, by its first byte
_LENGTH[0xC0:0xE0], _LENGTH[0xE0:0xF0], _LENGTH[0xF0:] = 2, 3, 4


@dataclass
class Vocabulary:
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray  # piece of a node, -1 for none
    score: np.ndarray
    unknown: float
    byte_piece: np.ndarray  # piece of each byte
    text: list[bytes]  # what each piece decodes to, markers as spaces

    @functools.cached_property
    def lists(self) -> tuple[list[int], list[int], list[int], list[float]]:
        return self.base.tolist(), self.check.tolist(), self.value.tolist(), self.score.tolist()


def log_scores(score: np.ndarray) -> np.ndarray:
    """Log scores of pieces: as they are, or from ranks (different whole numbers) by Zipf's law.

    Pieces that such a file ranks last of all (runs of markers, at -1e9) count as of the rank behind the others.
    """
    ranked = score > -1e8
    rank = np.where(ranked, -score, len(score))
    if len(score) < 2 or (rank != np.round(rank)).any() or len(np.unique(rank[ranked])) < ranked.sum() or rank.min() < 0:
        return score
    return -np.log(rank + ZIPF) - np.log((1 / (rank + ZIPF)).sum())


def double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of a trie over byte strings: the child of node n by byte c is base[n] + c if check says n."""
    children: dict[bytes, set[int]] = defaultdict(set)
    for key in keys:
        for i in range(len(key)):
            children[key[:i]].add(key[i])
    value_of = {key: i for i, key in enumerate(keys)}
    size = 1 << 12
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    used = np.zeros(size, bool)
    used[0] = True
    free = 257  # below, no base would be positive for every byte
    stack = [(0, b"")]
    while stack:
        node, prefix = stack.pop()
        codes = np.array(sorted(children.get(prefix, ())), np.int64)
        if not len(codes):
            continue
        while free < len(used) and used[free]:
            free += 1
        at, span = free, 64
        while True:
            if at + span + 512 > len(used):
                grow = max(len(used), span + 512)
                base, check, value = (np.concatenate([a, np.full(grow, fill, np.int32)]) for a, fill in ((base, 0), (check, -1), (value, -1)))
                used = np.concatenate([used, np.zeros(grow, bool)])
            b = at + np.flatnonzero(~used[at : at + span]) - codes[0]  # the first child in a free place
            b = b[b > 0]
            b = b[~used[b[:, None] + codes].any(1)]
            if len(b):
                b = int(b[0])
                free = at if at > free and used[free:at].mean() > 0.9 else free  # leave places that are hard to fill
                break
            at, span = at + span, min(2 * span, 4096)
        base[node] = b
        for c in codes.tolist():
            child = b + c
            used[child], check[child] = True, node
            longer = prefix + bytes([c])
            value[child] = value_of.get(longer, -1)
            stack.append((child, longer))
    return base, check, value


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    score = np.array([sp.get_score(i) for i in range(n)])
    pieces = [sp.id_to_piece(i) for i in range(n)]
    own = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    if any(_MARK in pieces[i].lstrip(_MARK) for i in own):
        raise ValueError("a piece holds a marker after another character")
    byte_piece = np.full(256, -1, np.int64)
    text = [p.replace(_MARK, " ").encode() for p in pieces]
    for i in range(n):
        if sp.is_byte(i):
            b = int(pieces[i][3:5], 16)
            byte_piece[b], text[i] = i, bytes([b])
        elif sp.is_control(i):
            text[i] = b""
        elif sp.is_unknown(i):
            text[i] = " ⁇ ".encode()
    byte_piece[byte_piece < 0] = sp.unk_id()
    score[own] = log_scores(score[own])
    base, check, at = double_array([pieces[i].encode() for i in own])
    value = np.where(at >= 0, np.array(own)[at], -1)
    return Vocabulary(base, check, value, score, float(score[own].min()) - UNKNOWN_PENALTY, byte_piece, text)


def _segment(v: Vocabulary, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of words given as a byte matrix (byte, word) filled up with 0xFF: all pieces, and each word's count."""
    width, n = words.shape
    best = np.full((width + 5, n), -np.inf)
    back = np.zeros((width + 5, n), np.int32)  # length of the last piece
    piece = np.full((width + 5, n), -1, np.int32)
    best[0] = 0

    def offer(end: np.ndarray, lane: np.ndarray, s: np.ndarray, start: int, p: np.ndarray | int) -> None:
        better = s > best[end, lane]
        e, w = (end[better] if isinstance(end, np.ndarray) else end), lane[better]
        best[e, w], back[e, w] = s[better], e - start
        piece[e, w] = p if isinstance(p, int) else p[better]

    for i in range(width):
        lanes = np.flatnonzero((best[i] > -np.inf) & (lengths > i))
        if not len(lanes):
            continue
        one = _LENGTH[words[i, lanes]]
        alone = np.zeros(len(lanes), bool)
        at, node = np.arange(len(lanes)), np.zeros(len(lanes), np.int64)
        for j in range(i, width):
            nxt = v.base[node] + words[j, lanes[at]].astype(np.int64)
            ok = v.check[nxt] == node
            at, node = at[ok], nxt[ok]
            if not len(at):
                break
            found = v.value[node]
            hit = found >= 0
            if hit.any():
                a, p = at[hit], found[hit]
                alone[a[one[a] == j + 1 - i]] = True
                offer(np.full(len(a), j + 1), lanes[a], best[i, lanes[a]] + v.score[p], i, p)
        rest = np.flatnonzero(~alone)
        if len(rest):
            offer(i + one[rest], lanes[rest], best[i, lanes[rest]] + v.unknown, i, -1)

    out: list[tuple[np.ndarray, np.ndarray]] = []  # from the end: words and their pieces
    end, lane = lengths.astype(np.int64).copy(), np.arange(n)
    while len(lane):
        lane = lane[end[lane] > 0]
        if not len(lane):
            break
        p, size = piece[end[lane], lane], back[end[lane], lane]
        out.append((lane[p >= 0], p[p >= 0]))
        unknown = np.flatnonzero(p < 0)
        for k in range(4):  # the bytes of unknown characters, last first
            u = unknown[size[unknown] > k]
            if len(u):
                out.append((lane[u], v.byte_piece[words[end[lane[u]] - 1 - k, lane[u]]].astype(np.int32)))
        end[lane] -= size
    owner = np.concatenate([o for o, _ in out]) if out else np.zeros(0, np.int64)
    pieces = np.concatenate([p for _, p in out]) if out else np.zeros(0, np.int32)
    nth = np.arange(len(owner))
    order = np.lexsort((-nth, owner))
    return pieces[order], np.bincount(owner, minlength=n)


def _segment_one(v: Vocabulary, word: bytes) -> np.ndarray:
    """Pieces of one word, by the same recursion byte after byte."""
    base, check, value, score = v.lists
    n = len(word)
    best, back, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    for i in range(n):
        here = best[i]
        if here == -np.inf:
            continue
        single, alone, node = i + int(_LENGTH[word[i]]), False, 0
        for j in range(i, n):
            to = base[node] + word[j]
            if check[to] != node:
                break
            node = to
            p = value[node]
            if p >= 0:
                alone = alone or j + 1 == single
                if here + score[p] > best[j + 1]:
                    best[j + 1], back[j + 1], piece[j + 1] = here + score[p], i, p
        if not alone and here + v.unknown > best[single]:
            best[single], back[single], piece[single] = here + v.unknown, i, -1
    out: list[int] = []
    end = n
    while end:
        start = back[end]
        out += [piece[end]] if piece[end] >= 0 else [int(v.byte_piece[b]) for b in reversed(word[start:end])]
        end = start
    return np.array(out[::-1], np.int32)


def segment(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all words one after another, and where each word's begin (len(words) + 1 offsets)."""
    lengths = np.array([len(w) for w in words], np.int64)
    classes = np.ceil(np.log2(np.maximum(lengths, 4))).astype(int)
    counts = np.zeros(len(words), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for k in np.flatnonzero(lengths > LONG_WORD):
        pieces = _segment_one(v, words[k])
        counts[k] = len(pieces)
        parts.append((np.array([k]), np.array([len(pieces)]), pieces))
    for c in np.unique(classes[lengths <= LONG_WORD]):
        members = np.flatnonzero((classes == c) & (lengths <= LONG_WORD))
        step = max(1, min(LANES, (LANES * 16) >> int(c)))
        for i in range(0, len(members), step):
            some = members[i : i + step]
            width = int(lengths[some].max())
            grid = np.frombuffer(b"".join(words[k].ljust(width, b"\xff") for k in some), np.uint8).reshape(len(some), width).T
            pieces, n = _segment(v, np.ascontiguousarray(grid), lengths[some])
            counts[some] = n
            parts.append((some, n, pieces))
    offsets = np.concatenate(([0], np.cumsum(counts)))
    flat = np.zeros(int(offsets[-1]), np.int32)
    for some, n, pieces in parts:
        flat[ragged(offsets[some], n)] = pieces
    return flat, offsets


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then the same for the next."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def marked(text: str | None) -> str:
    """The text as it is segmented, with spaces for markers; an empty or null text has none."""
    return " " + text.replace(_MARK, " ") if text else ""


class Segmenter:
    """Segmentations of words, kept until there are TABLE_WORDS of them; so a frequent word is segmented once."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = defaultdict(itertools.count().__next__)
        self.flat = np.zeros(0, np.int32)
        self.at = np.zeros(1, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all texts one after another, and their len(texts) + 1 offsets."""
        if len(self.index) > TABLE_WORDS:
            self._clear()
        known, number = len(self.index), self.index.__getitem__
        split = [np.fromiter(map(number, _WORD.findall(marked(t))), np.int64) for t in texts]
        new = list(itertools.islice(reversed(self.index), len(self.index) - known))[::-1]
        flat, at = segment(self.v, [w.replace(" ", _MARK).encode() for w in new])
        self.flat, self.at = np.concatenate([self.flat, flat]), np.concatenate([self.at, self.at[-1] + at[1:]])
        words = np.concatenate([*split, np.zeros(0, np.int64)])
        counts = np.diff(self.at)[words]
        pieces = self.flat[ragged(self.at[words], counts)]
        ends = np.cumsum([0, *map(len, split)])
        return pieces, np.concatenate(([0], np.cumsum(counts)))[ends]


def encode(v: Vocabulary, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return Segmenter(v).encode(texts)


@functools.cache
def segmenter(path: str) -> Segmenter:
    """One table per worker process; what it holds never changes a result."""
    return Segmenter(vocabulary(path))


@functools.lru_cache(2)
def _piece_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    text = vocabulary(path).text
    size = np.array([len(t) for t in text], np.int64)
    return np.frombuffer(b"".join(text), np.uint8), np.cumsum(size) - size, size


def decode(path: str, pieces: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Texts of pieces: markers become spaces, byte pieces join to UTF-8 (what isn't valid becomes U+FFFD), and the leading space goes."""
    data, start, size = _piece_bytes(path)
    joined = data[ragged(start[pieces], size[pieces])].tobytes()
    ends = np.concatenate(([0], np.cumsum(size[pieces])))[offsets]
    return [joined[i:j].removeprefix(b" ").decode("utf-8", "replace") for i, j in itertools.pairwise(ends.tolist())]


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= BLOCK_CHARS):
            size += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: its id, ids (array of pieces), n_pieces, n_byte_pieces and round_trip.

    model: path of a SentencePiece file whose pieces hold markers in front only. Every text is encoded whole and
    decoded again; round_trip says that the result is the text, U+2581 counting as a space. Null and empty texts
    have no pieces and make the round trip to the empty text. Of equally good segmentations the one whose last
    piece is longest is taken. Repeated rows and null ids give a row each, an empty table none; other columns are
    ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, words = vocabulary(model), segmenter(model)
        is_byte = np.zeros(len(v.score), np.int64)
        is_byte[np.unique(v.byte_piece)] = 1
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for i, j in _blocks(texts):
                pieces, offsets = words.encode(texts[i:j])
                same = [d == marked(t)[1:] for d, t in zip(decode(model, pieces, offsets), texts[i:j], strict=True)]
                n_bytes = np.diff(np.concatenate(([0], np.cumsum(is_byte[pieces])))[offsets])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(pieces)), pa.array(np.diff(offsets)), pa.array(n_bytes), pa.array(same)],
                    ["id", "ids", "n_pieces", "n_byte_pieces", "round_trip"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, n_pieces long, n_byte_pieces long, round_trip boolean").withColumnRenamed("id", id_col)


def decode_texts(encoded: DataFrame, model: str, id_col: str = "doc_id") -> DataFrame:
    """Per row of encoded (id, ids array<int>): its id and text. Null ids give an empty text, as do none; null pieces are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[p for p in x or () if p is not None] for x in batch.column(1).to_pylist()]
            pieces = np.array(list(itertools.chain.from_iterable(lists)), np.int64)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decode(model, pieces, offsets), pa.string())], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), "ids").mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
