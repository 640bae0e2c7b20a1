"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

Documents are tokenised and packed in one pass over the scan, without a
shuffle: what is longer than a window gives full windows, and the remainders
are packed in blocks of a fixed number of windows. A block's pieces start as
partial partitions of their own; the two with the largest spread are merged
again and again with opposing imbalances, which gives near-equal windows. If
the fullest window exceeds the capacity, the block is packed anew with one
window more.

A sequence id is made of the task's partition and a counter, so a task that
runs again gives the same ids.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

CAPACITY = 1024
#: Windows packed together, tokens left free in each on average, longest piece of a remainder.
BLOCK, SLACK, PIECE = 32, 12, 256
SPECIAL = "<|endoftext|>"
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def encoder(path: str | None):
    """A function from a text to its ids as an array: those of the vocabulary file in the tokenizers library.

    A text is cut between an ASCII character and a blank or line feed after it,
    where no token of the library's pattern goes across and none looks ahead.
    Pieces of characters below U+0250 without a special token are encoded by
    tiktoken with the file's ranks, which is faster and gives the same ids;
    what holds other characters, and what tiktoken refuses (a million blanks
    in a row), goes to the library itself.
    """
    import json
    import re

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in printable}
    shown |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ranks = {bytes(shown[c] for c in t): i for t, i in model["vocab"].items() if t != SPECIAL}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    other = re.compile(f"[^\x00-ɏ]|{re.escape(SPECIAL)}").search
    cut = re.compile(r"(?<=[!-~])(?=[ \n])").split

    def slow(piece: str) -> np.ndarray:
        return np.array(whole.encode(piece, add_special_tokens=False).ids, np.uint32)

    def quick(piece: str) -> np.ndarray:
        try:
            return np.asarray(fast.encode_to_numpy(piece, disallowed_special=()), np.uint32)
        except ValueError:
            return slow(piece)

    def encode(text: str) -> np.ndarray:
        if not other(text):
            return quick(text)
        runs = groupby(cut(text), key=lambda piece: bool(other(piece)))
        return np.concatenate([(slow if rare else quick)("".join(pieces)) for rare, pieces in runs])

    return encode


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indexes of ``sizes`` in k groups of near-equal sums (largest differencing method)."""
    heap = []
    for i, n in enumerate(sizes):
        parts = [(n, [i])]
        heap.append((-n, i, parts))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, tie, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # parts are kept from the fullest down, empty ones left out: opposite ends meet
        if len(a) + len(b) <= k:
            merged = a + b
        else:
            short = k - len(a)
            merged = a[: k - len(b)] + b[:short]
            merged += [(x + y, p + q) for (x, p), (y, q) in zip(a[k - len(b) :], reversed(b[short:]), strict=True)]
        merged.sort(key=lambda part: -part[0])
        heapq.heappush(heap, (-(merged[0][0] - (merged[-1][0] if len(merged) == k else 0)), tie, merged))
    groups = [p for _, p in heap[0][2]] if heap else []
    return groups + [[] for _ in range(k - len(groups))]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups none of which exceeds ``capacity``; the count rises until that holds."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = differencing(sizes, k)
        if all(sum(sizes[i] for i in g) <= capacity for g in groups):
            return [g for g in groups if g]
        k += 1


class _Packer:
    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.rows: list[tuple] = []
        self.open: list[tuple] = []
        self.open_size = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, at, raw = len(ids), 0, ids.tobytes()
        while n - at >= self.capacity:
            self.rows.append((doc_id, at, self.capacity, raw[4 * at : 4 * (at + self.capacity)], n, self.next, 0))
            self.next += 1
            at += self.capacity
        full = BLOCK * (self.capacity - min(SLACK, self.capacity // 8))
        while at < n:
            size = min(PIECE, n - at, full - self.open_size)
            self.open.append((doc_id, at, size, raw[4 * at : 4 * (at + size)], n))
            self.open_size += size
            at += size
            if self.open_size >= full:
                self.close()

    def close(self) -> None:
        for group in windows([p[2] for p in self.open], self.capacity):
            offset = 0
            for i in sorted(group):
                self.rows.append((*self.open[i], self.next, offset))
                offset += self.open[i][2]
            self.next += 1
        self.open, self.open_size = [], 0

    def take(self, schema: pa.Schema) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """One row for each piece of ``docs(doc_id, text)``, with its ids (little-endian unsigned 32-bit).

    ``start`` is the piece's place in its document, ``offset`` its place in its
    sequence. A document of ``capacity`` ids or more gives full windows first,
    which need no balancing; what is left of it is packed by differencing. A null text counts as empty and gives the single id ``end_id``; a
    null doc_id is carried through; repeated rows are packed each on its own; an
    empty table gives no rows; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], np.uint32)
        packer = _Packer(capacity, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                packer.add(doc_id.as_py(), np.concatenate([encode(text.as_py() or ""), end]))
                if len(packer.rows) >= 1024:
                    yield packer.take(schema)
        if packer.open:
            packer.close()
        if packer.rows:
            yield packer.take(schema)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
