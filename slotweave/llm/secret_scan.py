"""Secrets in texts: fixed patterns, and random strings by a token-efficiency test.

A byte-pair vocabulary holds the pieces that language is made of, so words and identifiers take few tokens and random
strings many. A run of RUN characters is a secret of kind `random` if it has at least LEAST_CHARS characters and fewer
than MOST_CHARS_PER_TOKEN characters a token, unless it overlaps a span of the fixed patterns, is a known digest (the
hexadecimal length of a common hash, or a hash's name before it) or an identifier (a UUID, a number, a date or time, a
path, address or compound of words). Every row is judged by itself: nothing is shuffled.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_CHARS = 20
MOST_CHARS_PER_TOKEN = 1.9
#: Runs whose verdict is kept in a worker.
KNOWN_RUNS = 100_000

#: The fixed patterns by kind, in the order in which kinds are listed; with the group that is measured and its least length.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    # A run of 24 or more is found alike whether shorter ones are matched and dropped or passed over.
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),
}
KINDS = [*BASE, "random"]

#: A run: neither touched by another character of its kind nor by a letter beyond ASCII.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=\x80-\U0010FFFF-])[A-Za-z0-9+/_=-]{%d,}(?![A-Za-z0-9+/_=\x80-\U0010FFFF-])" % LEAST_CHARS)
#: Hexadecimal lengths of common digests (fixed values).
DIGEST_CHARS = {32, 40, 48, 56, 64, 96, 128}
_DIGEST_NAME = re.compile(r"(?:md5|sha-?\d{1,3}|blake\w{1,3}|crc\d+|digest|checksum|integrity)\W{0,3}$", re.ASCII | re.IGNORECASE)
_DIGEST_PREFIX = re.compile(r"(?:md5|sha-?\d{1,3})[-_=/]", re.ASCII | re.IGNORECASE)
_HEX = re.compile(r"[0-9A-Fa-f]+\Z")
_UUID = re.compile(r"(?:urn-?)?[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")
_NUMBER = re.compile(r"[0-9TZ+/_=-]+\Z")
#: What identifiers are made of: a word in one case, or a number.
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_JOINT = re.compile(r"[+/_=-]+")
#: Letters of a part, on average, from which several parts are a compound of words.
WORD_CHARS = 5


def is_digest(run: str, before: str) -> bool:
    """Whether a run is a known kind of digest; before: the text just before it."""
    return bool(_HEX.match(run) and len(run) in DIGEST_CHARS) or bool(_DIGEST_PREFIX.match(run)) or bool(_DIGEST_NAME.search(before))


def is_identifier(run: str) -> bool:
    """Whether a run is a UUID, a number or date, a line of signs, or a compound of words and numbers."""
    if _UUID.match(run) or _NUMBER.match(run) or len(set(run)) < 5:
        return True
    pieces = [p for p in _JOINT.split(run) if p]
    parts = [_PART.findall(p) for p in pieces]
    if len(pieces) == 1 and len(parts[0]) == 1:
        return False  # one long word: left to the test
    flat = [x for p in parts for x in p]
    letters = [x for x in flat if not x[0].isdigit()]
    return bool(letters) and sum(map(len, letters)) >= WORD_CHARS * len(letters) and len(flat) - len(letters) <= len(letters) and sum(map(len, letters)) * 2 >= len(run)


@functools.cache
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Scanner:
    """Spans of texts under one vocabulary file."""

    def __init__(self, path: str):
        self.encode = _encoding(path).encode_ordinary
        self.known: dict[str, bool] = {}

    def is_random(self, run: str) -> bool:
        """Whether a run takes so many tokens that it can't be language."""
        found = self.known.get(run)
        if found is None:
            if len(self.known) >= KNOWN_RUNS:
                self.known.clear()
            found = self.known[run] = len(run) < MOST_CHARS_PER_TOKEN * len(self.encode(run))
        return found

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of what the fixed patterns find, in order."""
        out = []
        for k, (pattern, group, least) in enumerate(BASE.values()):
            out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
        out.sort()
        return out

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """(start, kind, end) of random runs that overlap no base span."""
        out = []
        for m in RUN.finditer(text):
            start, end = m.start(), m.start() + len(m[0].rstrip("=-_/+"))
            start += len(m[0]) - len(m[0].lstrip("=-_/+"))
            run = text[start:end]
            if end - start < LEAST_CHARS or any(s < end and start < e for s, _, e in base):
                continue
            if is_digest(run, text[max(0, start - 16) : start]) or is_identifier(run):
                continue
            if self.is_random(run):
                out.append((start, len(KINDS) - 1, end))
        return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans)


@functools.cache
def scanner(path: str) -> Scanner:
    """One per worker process; what it keeps never changes a verdict."""
    return Scanner(path)


def scan_secrets(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random.

    vocabulary: path of a file of tiktoken ranks. Spans are kind:start:end in code points, end exclusive, ordered by start
    and kind, comma-joined; base_sha256 is the digest of those of the fixed patterns. Spans of one kind don't overlap.

    Null and empty texts have no span (and the digest of an empty string). Texts are scanned whole, however long. Every row
    gives one of its own: repeated rows and null ids too; an empty table gives none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(vocabulary)
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, spans = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = scan.base(text)
                every = sorted(base + scan.added(text, base))
                for k, column in enumerate(counts):
                    column.append(sum(x[1] == k for x in every))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string"
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    return found.select("doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_random")
