"""Encoding by a public byte-level BPE vocabulary, with a segment tree over adjacent pair ranks.

The parts of a pretoken form a linked list; leaf ``i`` of the tree holds the rank of the pair that
starts at part ``i``.  The root holds the lowest rank, and descending to the left on ties finds the
leftmost pair that has it.  A merge changes two or three leaves, each repaired on the way up, so a
pretoken of ``n`` bytes takes ``O(n log n)``, however long it is.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pretoken pattern that belongs to the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

#: Where the vocabulary files lie unless a caller says otherwise.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_NONE = 1 << 60


#: Largest vocabulary file that is sent to the executors.
MOST_BYTES = 64 << 20


def read_ranks(blob: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a token in base64 and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in blob.splitlines() if line.strip())}


@lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    return read_ranks(Path(path).read_bytes())


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pretoken."""
    n = len(word)
    if n == 0:
        return []
    if n == 1:
        return [ranks[word]]
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)
    parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    for i in range(n - 1):
        tree[size + i] = get(word[i : i + 2], _NONE)
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b

    def put(leaf: int, rank: int) -> None:
        i = size + leaf
        tree[i] = rank
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a <= b else b
            if tree[i] == low:
                return
            tree[i] = low
            i >>= 1

    while (low := tree[1]) < _NONE:
        i = 1
        while i < size:
            i *= 2
            if tree[i] != low:
                i += 1
        i -= size
        j = after[i]
        joined = parts[i] + parts[j]
        parts[i], parts[j] = joined, None
        k = after[i] = after[j]
        if j < n - 1:
            put(j, _NONE)
        if k < n:
            before[k] = i
            put(i, get(joined + parts[k], _NONE))
        else:
            put(i, _NONE)
        h = before[i]
        if h >= 0:
            put(h, get(parts[h] + joined, _NONE))
    return [ranks[p] for p in parts if p is not None]


class Encoder:
    """Encodes texts by ``ranks`` (or the path of their file); ids of pretokens are kept up to ``memory`` entries, which changes speed only."""

    def __init__(self, ranks: str | dict[bytes, int], pattern: str = PATTERN, memory: int = 1 << 18):
        import regex

        self.ranks = load_ranks(ranks) if isinstance(ranks, str) else ranks
        self.split = regex.compile(pattern).findall
        self.memory = memory
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, out = self.known, []
        for word in self.split(text):
            ids = known.get(word)
            if ids is None:
                ids = merge(word.encode("utf-8", "surrogatepass"), self.ranks)
                if len(word) <= 64:
                    if len(known) >= self.memory:
                        known.clear()
                    known[word] = ids
            out += ids
        return out


#: The encoder of this Python worker, of the last vocabulary and pattern only.
_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encode(df: DataFrame, *, text: str = "text", ids: str = "ids", keep: list[str] | None = None, vocabulary: str = VOCABULARY, pattern: str = PATTERN, chunk: int = 1 << 22) -> DataFrame:
    """``keep`` (default: all other columns) and the ids of ``text`` as an array of ints.

    Null and empty texts have the empty list; strings that look like special tokens are ordinary
    text; one row comes out for each that goes in.  The work is one pass without a shuffle.  A
    column that is already named ``ids`` is replaced.  ``vocabulary`` is read on the driver and sent
    to the executors; a file of more than ``MOST_BYTES`` is refused.
    ``chunk`` bounds the bytes of text encoded at a time within a batch.
    """
    if Path(vocabulary).stat().st_size > MOST_BYTES:
        raise ValueError(f"{vocabulary} is too large to be sent to the executors")
    content = Path(vocabulary).read_bytes()
    key, blob = (hashlib.sha256(content).hexdigest(), pattern), df.sparkSession.sparkContext.broadcast(content)
    keep = [c for c in (df.columns if keep is None else keep) if c not in (text, ids)]
    source = df.select(*keep, F.col(text).cast("string").alias(text))
    schema = source.select(*keep).withColumn(ids, F.array(F.lit(0))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(read_ranks(blob.value), pattern)
        encoder = _ENCODERS[key]
        for batch in batches:
            rows = max(1, min(batch.num_rows, batch.num_rows * chunk // max(1, batch.nbytes)))
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                lists = [encoder.encode(x) for x in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(lists, pa.list_(pa.int32()))], names=[*keep, ids])

    return source.mapInArrow(run, schema)
