"""Token counts of whole texts.

Batch encoding in Arrow functions that return lengths only. Long texts are split at safe boundaries, and
the pieces are encoded in batches balanced by bytes. A safe boundary is a place between a character that
is not white space and one that is: the byte-level pre-tokenizer never lets a token cross it, its only
look-ahead concerns the white space after it, and no added token holds white space. So the token count of
a text is the sum of the counts of its pieces, whatever the length of the text, and equal pieces are
encoded once per task while they stay in a bounded table. Texts holding U+001C..U+001F, which Python and
the tokenizer class differently, are encoded whole.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 256 << 10
TABLE_PIECES = 400_000

_PIECE = re.compile(r"\s*\S+|\s+")
_ODD = re.compile("[\x1c-\x1f]")


def safe_pieces(text: str) -> list[str]:
    """Pieces that concatenate to text and are tokenized independently of one another."""
    return [text] if _ODD.search(text) else _PIECE.findall(text)


def balanced(pieces: list[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Runs of pieces of about `limit` bytes; a longer piece is a run of its own."""
    run: list[str] = []
    size = 0
    for piece in pieces:
        n = len(piece) if piece.isascii() else len(piece.encode())
        if run and size + n > limit:
            yield run
            run, size = [], 0
        run.append(piece)
        size += n
    if run:
        yield run


@functools.cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class PieceCounts:
    """Token counts of pieces, in a table of two generations: when the new one is full, the old one goes.

    So pieces in use stay, and memory is bounded by twice TABLE_PIECES entries besides the current texts.
    """

    def __init__(self, path: str):
        self.encode = _tokenizer(path).encode_batch_fast
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def add(self, pieces: set[str]) -> None:
        if len(self.known) > TABLE_PIECES:
            self.older, self.known = self.known, {}
        new = pieces.difference(self.known)
        again = new.intersection(self.older)
        self.known.update((p, self.older[p]) for p in again)
        for run in balanced(list(new - again)):
            self.known.update(zip(run, map(len, self.encode(run, add_special_tokens=False)), strict=True))

    def count(self, texts: list[str | None]) -> list[int]:
        out: list[int] = []
        for run in balanced([t or "" for t in texts], 4 * BATCH_BYTES):
            split = [safe_pieces(t) for t in run]
            self.add(set().union(*split))
            out += [sum(map(self.known.__getitem__, pieces)) for pieces in split]
        return out


@functools.cache
def piece_counts(path: str) -> PieceCounts:
    """One table per worker process; what it holds never changes a count."""
    return PieceCounts(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: its id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    tokenizer: path of a byte-level BPE file of the tokenizers library. Every text is counted whole; a
    null or empty text has 0 bytes and 0 tokens. Special strings inside a text count as the library
    takes them by default; nothing is added, cut or padded. Rows are not merged: repeated rows, null ids
    and ties each give their own row; an empty table gives none. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = piece_counts(tokenizer)
        for batch in batches:
            tokens = counts.count(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
