"""Text kernels over Arrow buffers: words, 64-bit word hashes and word windows of many texts at once.

A word is a maximal run of bytes other than space and 0x09-0x0D, which equals the pattern
``[^\\x20\\x09-\\x0D]+`` on the text. Work proceeds in blocks of about BLOCK bytes, so memory stays
bounded whatever the batch; a text longer than that is a block of its own and its words are hashed in
slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_SPAN = 1 << 16

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants derived from a seed; the same in every process."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


CODE = constants(256, 11)
CODE[SPACE] = 0
CODE_LOWER = CODE.copy()
CODE_LOWER[65:91] = CODE[97:123]
_POWER = np.cumprod(np.full(_SPAN, constants(1, 12)[0], np.uint64))
_WINDOW = constants(64, 13)


@dataclass
class Text:
    """Texts i..j of a batch: their bytes and the j - i + 1 offsets into them."""

    at: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def texts(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK) -> Iterator[Text]:
    """Blocks of a string column, without copying the bytes; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield Text(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


@dataclass
class Words:
    """Words of a block: byte spans, and for text t the words first[t]..first[t + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split_words(block: Text, kind: np.ndarray | None = None) -> Words:
    """Maximal runs of one byte kind other than 0 (default kinds: 0 for space, 1 for all else)."""
    kinds = (~SPACE).astype(np.uint8) if kind is None else kind
    k = kinds[block.data]
    n = len(k)
    cut = np.ones(n + 1, bool)
    if n:
        cut[1:n] = k[1:] != k[:-1]
        cut[block.offsets] = True
    word = k != 0
    starts = np.flatnonzero(word & cut[:n])
    ends = np.flatnonzero(word & cut[1:]) + 1
    return Words(starts, ends, np.searchsorted(starts, block.offsets))


def word_hashes(block: Text, words: Words, code: np.ndarray = CODE_LOWER) -> np.ndarray:
    """A 64-bit hash of each word; with CODE_LOWER, A-Z count as a-z. Long words are hashed in pieces of _SPAN bytes."""
    length = words.ends - words.starts
    if not len(length) or length.max() <= _SPAN:
        return _piece_hashes(block, words.starts, length, code)
    count = -(-length // _SPAN)
    begin = np.concatenate(([0], np.cumsum(count)[:-1]))
    place = np.arange(int(count.sum())) - np.repeat(begin, count)
    sizes = np.minimum(np.repeat(length, count) - place * _SPAN, _SPAN)
    pieces = _piece_hashes(block, np.repeat(words.starts, count) + place * _SPAN, sizes, code)
    joined = mix(np.add.reduceat(mix(pieces + place.astype(np.uint64) * CODE[2]), begin) + length.astype(np.uint64) * CODE[1])
    return np.where(count > 1, joined, pieces[begin])


def _piece_hashes(block: Text, starts: np.ndarray, length: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Hashes of byte spans of at most _SPAN bytes, in slices so that memory stays bounded."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(out):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK)))
        n = length[i:j]
        total, begin = int(n.sum()), np.concatenate(([0], np.cumsum(n)[:-1]))
        inside = np.arange(total) - np.repeat(begin, n)
        value = code[block.data[inside + np.repeat(starts[i:j], n)]] * _POWER[inside]
        out[i:j] = mix(np.add.reduceat(value, begin) + n.astype(np.uint64) * CODE[1])
        i = j
    return out


def windows(hashes: np.ndarray, words: Words, size: int, whole_if_short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of `size` words inside one text, and the index of its first word.

    whole_if_short: a text of fewer words, but at least one, gives one window of all its words.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = words.owner()
    left = words.first[owner + 1] - np.arange(n)  # words from here to the end of the text
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    acc = np.zeros(n, np.uint64)
    for k in range(size):
        acc += np.where(left > k, padded[k : k + n], np.uint64(0)) * _WINDOW[k]
    valid = left >= size
    if whole_if_short:
        count = np.diff(words.first)
        short = words.first[:-1][(count > 0) & (count < size)]
        valid[short] = True
    at = np.flatnonzero(valid)
    return mix(acc[at] + np.minimum(left[at], size).astype(np.uint64) * _WINDOW[-1]), at
