"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 8).

Method: merge replay. The corpus is read in blocks, one after the other in every task. The distinct word pieces of a
block that have not been met before are laid out as one chain of symbols with an inverted index from token pair to
positions, and every merge that occurs is applied in rank order, over all pieces at once, touching only the
neighbours of each merged pair. Pieces already encoded are kept in a table of bounded size. No shuffle takes place.

The vocabulary is read from `folder` on each executor; its path is a parameter and it is never copied.

Defined results: null and empty texts have the empty list; special token strings in a text are ordinary text; a text
of any length is encoded whole; repeated ids give one row each. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

FOLDER = "/opt/tokenizers"
FILE = "byte_bpe_50k.tiktoken"

#: Fixed value: how the public tokenizer parts a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pieces that a task keeps with their ids, and characters that it takes as one block.
KEPT, BLOCK = 400_000, 4_000_000


class Merges:
    """Merge ranks and the replay over a block of distinct pieces."""

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.bytes = [self.ranks[bytes([b])] for b in range(256)]
        self.split = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], int | None] = {}

    def rank(self, a: int, b: int) -> int | None:
        """Id of the token that the pair merges into, which is also its rank."""
        pair = (a, b)
        if pair not in self.pairs:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[pair] = self.ranks.get(self.tokens[a] + self.tokens[b])
        return self.pairs[pair]

    def replay(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece."""
        symbols: list[int] = []
        starts = []
        for piece in pieces:
            starts.append(len(symbols))
            symbols.extend(map(self.bytes.__getitem__, piece.encode("utf-8", "surrogatepass")))
            symbols.append(-1)  # a wall between pieces
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        for i in range(n - 1):
            a, b = symbols[i], symbols[i + 1]
            if a >= 0 and b >= 0 and (r := self.rank(a, b)) is not None:
                index.setdefault(r, []).append(i)
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            whole = self.tokens[r]
            for i in sorted(index.pop(r)):
                a = symbols[i]
                if a < 0:
                    continue
                j = after[i]
                b = symbols[j]
                if b < 0 or self.rank(a, b) != r or len(self.tokens[a]) + len(self.tokens[b]) != len(whole):
                    continue
                symbols[i], symbols[j] = r, -2  # merged into i; j is gone
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                if (h := before[i]) >= 0 and symbols[h] >= 0 and (q := self.rank(symbols[h], r)) is not None:
                    if q not in index:
                        index[q] = []
                        heapq.heappush(heap, q)
                    index[q].append(h)
                if k < n and symbols[k] >= 0 and (q := self.rank(r, symbols[k])) is not None:
                    if q not in index:
                        index[q] = []
                        heapq.heappush(heap, q)
                    index[q].append(i)
        out = []
        for s, e in zip(starts, [*starts[1:], n]):
            out.append([x for x in symbols[s : e - 1] if x >= 0])
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of every text of a block."""
        parts = [self.split(t) if t else [] for t in texts]
        new = [p for p in dict.fromkeys(chain.from_iterable(parts)) if p not in self.known]
        if len(self.known) + len(new) > KEPT:
            self.known.clear()
            new = list(dict.fromkeys(chain.from_iterable(parts)))
        if new:
            self.known.update(zip(new, self.replay(new)))
        get = self.known.__getitem__
        return [list(chain.from_iterable(map(get, p))) for p in parts]


@lru_cache(4)
def merges(path: str) -> Merges:
    """One table per process."""
    return Merges(path)


def blocks(texts: list[str | None], most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about `most` characters."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(df: DataFrame, id_col: str = "doc_id", text: str = "text", folder: str = FOLDER, file: str = FILE) -> DataFrame:
    """(id_col, ids): token ids of every text, without special tokens."""
    path = f"{folder}/{file}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merges(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in blocks(texts):
                ids = pa.array(table.encode(texts[a:b]), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], [id_col, "ids"])

    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")


def token_counts(df: DataFrame, id_col: str = "doc_id", text: str = "text", folder: str = FOLDER, file: str = FILE) -> DataFrame:
    """(id_col, n_tokens): number of tokens of every text, 0 for null and empty ones."""
    path = f"{folder}/{file}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merges(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in blocks(texts):
                sizes = pa.array([len(x) for x in table.encode(texts[a:b])], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), sizes], [id_col, "n_tokens"])

    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text).mapInArrow(run, f"`{id_col}` {id_type}, n_tokens long")
