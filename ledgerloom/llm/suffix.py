"""Removal of repeated 50-byte strings with suffix arrays by the difference cover.

A byte goes if it lies in a 50-byte string that also starts in a document with
a smaller id. Equal strings are found by sorting suffixes: triples at two of
three positions are sorted and named, the names are sorted recursively, the
remaining suffixes follow from their ranks, both are merged, and adjacent
suffixes are compared on 50 bytes. Only 50 bytes count, so recursion ends when
names stand for 81.

To sort where only some suffixes can be equal, and in parts of bounded size,
the work is dealt by content. Every 50-byte string holds the least, by hash, of
its 24-byte substrings (its anchor), the same one wherever the string occurs.
Strings that neighbour each other share an anchor and travel as one segment.
Anchors found in one document only are left out, which loses no match; the
segments of the others are dealt by anchor, so that each part holds all
occurrences of its strings, and each part is sorted by itself. A chunk of
documents sends equal segments once, for its smallest document; in the others
they are removed at once. A part does the same with what several chunks sent,
so that it sorts each distinct segment once. A task gathers what several chunks
have before it deals it to the parts, and what several parts found before it
deals that to the chunks: a row for each pair of chunk and part would make rows
that grow with the square of the input.

An anchor found in many chunks would gather too much in one part, as the edges
of a passage that very many documents share differ in each of them. Of the
strings of such anchors only those go on that more than one document has, and
they are dealt by anchors of 36 bytes, which part what the shorter anchor held
together and still let neighbours travel as one segment.

Exact copies of whole texts are resolved before, by digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64, sliced

LENGTH, GRAM = 50, 24
#: Bytes of a chunk of documents, of a slice hashed at once (fits a cache), and of the segments of a part.
CHUNK, SLICE, PART = 4_000_000, 131_072, 700_000
ANCHORS_PART = 600_000
#: An anchor in more chunks than this is hot; bytes of the longer anchors by which its strings are dealt.
HOT_CHUNKS, LONG_GRAM = 32, 36
PLACE_BITS = np.uint64(24)
#: Bytes that a task gathers before it deals them out, and of a batch of rows then.
GATHERED, DEALT = 32_000_000, 4_000_000
#: A document's place: its chunk, and its number there in so many bits.
LOCAL_BITS = 32


# --- suffix arrays -----------------------------------------------------------


def _names(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of triples and the name (from 1) of each."""
    bits = max(1, int(max(x.max() for x in (a, b, c))).bit_length())
    if 3 * bits > 63:
        a, bits = np.unique((a << bits) | b, return_inverse=True)[1].astype(np.int64), bits
        key = (a << bits) | c
    else:
        key = (((a << bits) | b) << bits) | c
    order = np.argsort(key)
    fresh = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    names = np.empty(len(key), np.int64)
    names[order] = np.cumsum(fresh)
    return order, names


def suffix_array(s: np.ndarray, least: int = LENGTH, covered: int = 1) -> np.ndarray:
    """Suffixes of ``s`` (values from 1), ordered by at least ``least`` symbols of the original text."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(s[i:])), np.int64)
    padded = np.concatenate([s.astype(np.int64), np.zeros(4, np.int64)])
    ends = n + (n % 3 == 1)
    one, two = np.arange(1, ends, 3), np.arange(2, ends, 3)
    sample = np.concatenate([one, two])
    order, names = _names(padded[sample], padded[sample + 1], padded[sample + 2])
    if names.max() < len(sample) and covered * 3 < least:
        order = suffix_array(names, least, covered * 3)
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(order) + 1)
    sample = sample[order]
    sample = sample[sample < n]
    zero = np.arange(0, n, 3)
    width = np.int64(int(rank.max()).bit_length())
    zero = zero[np.argsort((padded[zero] << width) | rank[zero + 1])]
    # how many sampled suffixes go before each of the others
    first, second = sample[sample % 3 == 1], sample[sample % 3 == 2]
    before = np.searchsorted((padded[first] << width) | rank[first + 1], (padded[zero] << width) | rank[zero + 1])
    bits = np.int64(max(1, int(padded.max()).bit_length()))
    if 2 * bits + width <= 63:
        key = lambda i: (((padded[i] << bits) | padded[i + 1]) << width) | rank[i + 2]
        before += np.searchsorted(key(second), key(zero))
    else:
        pairs = np.unique((padded[:-1] << bits) | padded[1:], return_inverse=True)[1]
        before += np.searchsorted((pairs[second] << width) | rank[second + 2], (pairs[zero] << width) | rank[zero + 2])
    out = np.empty(n, np.int64)
    # suffixes equal in all that counts stand in any order: keep the places apart
    places = np.maximum.accumulate(before) + np.arange(len(zero))
    free = np.ones(n, bool)
    free[places] = False
    out[places], out[free] = zero, sample
    return out


def repeated(text: np.ndarray, inside: np.ndarray, starts: np.ndarray, owner: np.ndarray, least: int = LENGTH) -> np.ndarray:
    """For each of ``starts`` in ``text`` (bytes), whether the ``least`` bytes there also start with a smaller owner.

    ``inside`` is false at separators; no string at ``starts`` holds one.
    """
    order = suffix_array(np.where(inside, text.astype(np.int64) + 2, 1), least)
    at = np.full(len(text), -1, np.int64)
    at[starts] = np.arange(len(starts))
    rows = at[order]
    rows = rows[rows >= 0]
    wide = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    words = wide[:-7].copy()
    for k in range(1, 8):
        words |= wide[k : len(wide) - 7 + k] << np.uint64(8 * k)
    place = starts[rows]
    same = np.ones(max(0, len(rows) - 1), bool)
    for off in [*range(0, least - 8, 8), least - 8]:
        same &= words[place[1:] + off] == words[place[:-1] + off]
    group = np.flatnonzero(np.concatenate([[True], ~same]))
    low = np.repeat(np.minimum.reduceat(owner[rows], group), np.diff([*group, len(rows)])) if len(rows) else owner[:0]
    out = np.zeros(len(starts), bool)
    out[rows] = owner[rows] > low
    return out


# --- anchors and segments ----------------------------------------------------


def _gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 24 bytes at each place (fewer places than bytes by 23)."""
    h = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))[buf]
    parts, n = {1: h}, 1
    while n < 16:
        half = parts[n]
        parts[2 * n] = half[:-n] * np.uint64(0x9E3779B97F4A7C15 + 2 * n) + (half[n:] ^ (half[n:] >> np.uint64(29)))
        n *= 2
    eight, sixteen = parts[8], parts[16]
    return mix64(sixteen[: len(buf) - 23] * np.uint64(0xC2B2AE3D27D4EB4F) + eight[16 : 16 + len(buf) - 23])


def anchors(buf: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, w0, w1): runs w0..w1 of string starts in ``buf`` that share an anchor, within documents at ``first``."""
    out: list[tuple[np.ndarray, ...]] = []
    valid = np.zeros(len(buf) + 1, np.int32)
    long = sizes >= LENGTH
    np.add.at(valid, first[long], 1)
    np.add.at(valid, first[long] + sizes[long] - LENGTH + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    run_start = np.zeros(len(buf), bool)
    run_start[first[long]] = True
    for at in range(0, max(0, len(buf) - LENGTH + 1), SLICE):
        part = buf[at : at + SLICE + LENGTH - 1]
        h = _gram_hashes(part)
        key = (h >> PLACE_BITS << PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
        low, n, span = key, 1, LENGTH - GRAM + 1
        while 2 * n <= span:
            low = np.minimum(low[:-n], low[n:])
            n *= 2
        count = len(part) - LENGTH + 1
        low = np.minimum(low[:count], low[span - n : span - n + count])
        chosen = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
        ok = valid[at : at + count]
        new = np.concatenate([[True], chosen[1:] != chosen[:-1]]) | run_start[at : at + count] | np.concatenate([[True], ~ok[:-1]])
        begin = np.flatnonzero(new & ok)
        stop = np.flatnonzero(np.concatenate([new[1:] | ~ok[1:], [True]]) & ok)
        out.append((h[chosen[begin]], begin + at, stop + at))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def _gather(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all [start, start + size), one after the other."""
    total = int(size.sum())
    step = np.ones(total, np.int64)
    head = np.concatenate([[0], np.cumsum(size)[:-1]])
    if total:
        step[head] = np.concatenate([[start[0]], start[1:] - (start[:-1] + size[:-1] - 1)])
    return buf[np.cumsum(step)]


def window_hashes(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 50 bytes at each of ``at`` (ascending)."""
    out = np.empty(len(at), np.uint64)
    for lo in range(0, len(buf), SLICE):
        i, j = np.searchsorted(at, lo), np.searchsorted(at, lo + SLICE)
        if i < j:
            part, w = buf[lo : lo + SLICE + LENGTH], at[i:j] - lo
            g = _gram_hashes(part)
            last = part[w + 48].astype(np.uint64) << np.uint64(8) | part[w + 49]
            out[i:j] = mix64(mix64(g[w]) * np.uint64(0x9E3779B97F4A7C15) + g[w + 24] * np.uint64(0xC2B2AE3D27D4EB4F) + last * np.uint64(0xD6E8FEB86659FD93))
    return out


def long_anchors(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, w0, w1): runs of the string starts ``at`` (ascending) that follow each other and share their least 36-byte substring."""
    span, key, place = LENGTH - LONG_GRAM + 1, np.empty(len(at), np.uint64), np.empty(len(at), np.int64)
    for lo in range(0, len(buf), SLICE):
        i, j = np.searchsorted(at, lo), np.searchsorted(at, lo + SLICE)
        if i < j:
            g = _gram_hashes(buf[lo : lo + SLICE + LENGTH])
            skip = LONG_GRAM - GRAM
            wide = mix64(g[:-skip] * np.uint64(0x9E3779B97F4A7C15) + g[skip:])
            w = at[i:j] - lo
            low, chosen = wide[w], w.copy()
            for k in range(1, span):
                less = wide[w + k] < low
                low, chosen = np.where(less, wide[w + k], low), np.where(less, w + k, chosen)
            key[i:j], place[i:j] = low, chosen + lo
    fresh = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (place[1:] != place[:-1])])[: len(at)]
    begin = np.flatnonzero(fresh)
    return key[begin], at[begin], at[np.concatenate([begin[1:], [len(at)]])[: len(begin)] - 1]


def _within(pool: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each of ``h`` is in the sorted ``pool``."""
    return pool[np.minimum(np.searchsorted(pool, h), len(pool) - 1)] == h if len(pool) else np.zeros(len(h), bool)


def _padded(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Segments that lie in ``data`` one after the other as rows of one width, each with its size."""
    width = 2 * LENGTH - GRAM
    mat = np.zeros((len(size), width + 4), np.uint8)
    mat[:, width] = size
    mat[:, :width][np.arange(width) < size[:, None]] = data
    return mat


def _same(mat: np.ndarray) -> np.ndarray:
    """A number for each row of bytes, equal for equal rows; the width is a multiple of 8."""
    key = np.zeros(len(mat), np.uint64)
    for k, column in enumerate(mat.view(np.uint64).T):
        key = mix64(key ^ (column * np.uint64(0xD1342543DE82EF95 + 2 * k)))
    order = np.argsort(key)
    equal = key[order][1:] == key[order][:-1]
    if not (mat[order[1:][equal]] == mat[order[:-1][equal]]).all():  # two rows with one hash
        return np.unique(mat.view(f"V{mat.shape[1]}").ravel(), return_inverse=True)[1]
    out = np.empty(len(mat), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], ~equal])) if len(mat) else order
    return out


def _merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals joined where they overlap or touch, by document."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    far = int(stop.max()) + 1
    reach = np.maximum.accumulate(doc * far + stop)
    fresh = np.concatenate([[True], (doc[1:] * far + start[1:]) > reach[:-1]])
    at = np.flatnonzero(fresh)
    return doc[at], start[at], np.maximum.reduceat(stop, at)


class Chunk:
    """Documents packed in one row: ids, sizes, digests and bytes."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.buf = np.frombuffer(row["bytes"], np.uint8)
        self.shas = row["shas"]
        self.first = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        h, w0, w1 = anchors(self.buf, self.first, self.sizes)
        return h, w0, w1, np.searchsorted(self.first, w0, side="right") - 1


CHUNK_SCHEMA = "chunk int, ids binary, sizes binary, shas binary, bytes binary"
CHUNK_NAMES = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]


def _pack(docs: pa.Table, chosen: pa.Table) -> pa.Table:
    wanted = set(zip(chosen.column("doc_id").to_pylist(), chosen.column("sha").to_pylist(), strict=True))
    ids, sizes, shas, parts = [], [], [], []
    for doc_id, sha, text in zip(docs.column("doc_id").to_pylist(), docs.column("sha").to_pylist(), docs.column("text"), strict=True):
        if (doc_id, sha) in wanted:
            wanted.discard((doc_id, sha))
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            ids.append(doc_id)
            sizes.append(len(raw))
            shas.append(sha)
            parts.append(raw)
    chunk = docs.column("chunk")[0].as_py() if docs.num_rows else 0
    rows = [[chunk], [np.array(ids, np.int64).tobytes()], [np.array(sizes, np.int64).tobytes()], [bytes.fromhex("".join(shas))], [b"".join(parts)]]
    types = [pa.int32()] + [pa.binary()] * 4
    return pa.table([pa.array(r if ids else [], t) for r, t in zip(rows, types, strict=True)], names=["chunk", "ids", "sizes", "shas", "bytes"])


def _edges(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    n = len(keys[0])
    new = np.zeros(max(0, n - 1), bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [n]]) if n else np.zeros(1, np.int64)


def _cells(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes of ``values`` from each edge to the next, without a copy for each."""
    values = np.ascontiguousarray(values)
    offsets = ((edges - edges[0]) * values.itemsize).astype(np.int32)
    data = values[edges[0] : edges[-1]]
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _flat(cells: pa.Array | pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """What cells hold, one after the other, and how much each holds."""
    values, counts = [np.zeros(0, kind)], [np.zeros(0, np.int64)]
    for x in cells.chunks if isinstance(cells, pa.ChunkedArray) else [cells]:
        if len(x):
            x = x.cast(pa.large_binary())
            at = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]
            if at[-1] > at[0]:
                values.append(np.frombuffer(x.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind))
            counts.append(np.diff(at) // np.dtype(kind).itemsize)
    return np.concatenate(values), np.concatenate(counts)


def _gathered(found: Iterator[tuple[int, object]], deal) -> Iterator[pa.RecordBatch]:
    """What ``deal`` makes of the items of ``found``, (bytes, item), a list of them at a time."""
    held, size = [], 0
    for more, item in found:
        held.append(item)
        size += more
        if size >= GATHERED:
            yield from deal(held)
            held, size = [], 0
    if held:
        yield from deal(held)


BLOBS = "part int, chunk binary, count binary, h binary, several binary"
SHARED = "kind string, chunk binary, count binary, h binary"
FLAGS = "chunk int, h binary, hot binary, w binary"


def _distinct(chunk: int, h: np.ndarray, doc: np.ndarray) -> tuple[int, tuple]:
    """The distinct hashes of a chunk, and for each whether more than one document has it."""
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    edges = _edges(h)
    first, last = edges[:-1], edges[1:] - 1
    return 9 * len(first), (chunk, h[first], doc[first] != doc[last])


def _blobs(parts: int):
    """The hashes of chunks by part."""

    def deal(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, several = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
        chunk = np.repeat(np.array([x[0] for x in held], np.int32), [len(x[1]) for x in held])
        part = (mix64(h) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        h, several, chunk, part = h[order], several[order], chunk[order], part[order]
        edges, runs = _edges(part), _edges(part, chunk)
        of_part = np.searchsorted(runs, edges)
        bits = [np.packbits(several[i:j]).tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)]
        columns = [pa.array(part[edges[:-1]]), _cells(chunk[runs[:-1]], of_part), _cells(np.diff(runs).astype(np.int32), of_part), _cells(h, edges), pa.array(bits, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in BLOBS.split(", ")])

    return deal


def _anchor_blobs(parts: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        for batch in sliced(batches, 1):
            row = batch.to_pylist()[0]
            h, _, _, doc = Chunk(row).anchors()
            yield _distinct(row["chunk"], h, doc)

    return lambda batches: _gathered(found(batches), _blobs(parts))


def _shared(hot_chunks: int | None):
    """The hashes of each chunk that more than one document has; those in many chunks apart. None: of windows."""

    def run(group: pa.Table) -> pa.Table:
        (h, sizes), (chunk, _), (count, _) = (_flat(group.column(name), kind) for name, kind in (("h", np.uint64), ("chunk", np.int32), ("count", np.int32)))
        several = [np.unpackbits(np.frombuffer(b.as_buffer(), np.uint8))[:n].astype(bool) for b, n in zip(group.column("several"), sizes, strict=True)]
        _, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
        many = times > 1
        many[inverse[np.concatenate(several)]] = True
        hot = times > hot_chunks if hot_chunks is not None else np.zeros(len(times), bool)
        rows = []
        for kind, mask in (("w" if hot_chunks is None else "h", many & ~hot), ("hot", many & hot)):
            mask = mask[inverse]
            left = np.concatenate([[0], np.cumsum(mask)])
            ends = np.cumsum(count, dtype=np.int64)
            n = left[ends] - left[ends - count]
            if n.any():
                rows.append((kind, chunk[n > 0].tobytes(), n[n > 0].astype(np.int32).tobytes(), h[mask].tobytes()))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.table([pa.array(x, pa.binary() if k else pa.string()) for k, x in enumerate(columns)], names=[x.split()[0] for x in SHARED.split(", ")])

    return run


def _flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared hashes by chunk."""

    def found() -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in sliced(batches, 16):
            yield batch.nbytes, batch

    def deal(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        for kind in ("h", "hot", "w"):
            own = table.filter(pc.equal(table.column("kind"), kind))
            (h, _), (chunk, _), (count, _) = (_flat(own.column(name), t) for name, t in (("h", np.uint64), ("chunk", np.int32), ("count", np.int32)))
            chunk = np.repeat(chunk, count)
            order = np.argsort(chunk, kind="stable")
            edges = _edges(chunk[order])
            cells, none = _cells(h[order], edges), pa.array([b""] * (len(edges) - 1), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(chunk[order][edges[:-1]], pa.int32()), *(cells if name == kind else none for name in ("h", "hot", "w"))], names=["chunk", "h", "hot", "w"])

    return _gathered(found(), deal)


def _with_flags(packed: DataFrame, flags: DataFrame) -> DataFrame:
    """Chunks that have flags, each in one row with them."""
    return packed.join(flags.groupBy("chunk").agg(*(F.collect_list(name).alias(name) for name in ("h", "hot", "w"))), "chunk")


def _pool(row: pa.RecordBatch, name: str) -> np.ndarray:
    return np.sort(_flat(row.column(name)[0].values, np.uint64)[0])


def _hot_windows(c: Chunk, h: np.ndarray, w0: np.ndarray, w1: np.ndarray, doc: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, document) of every string whose anchor is hot."""
    keep = _within(hot, h)
    first, count = w0[keep], (w1 - w0 + 1)[keep]
    at = np.repeat(first, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return window_hashes(c.buf, at), at, np.repeat(doc[keep], count)


def _window_blobs(parts: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        for row in sliced(batches, 1):
            hot = _pool(row, "hot")
            if len(hot):
                c = Chunk(row.select(CHUNK_NAMES).to_pylist()[0])
                h, _, doc = _hot_windows(c, *c.anchors(), hot)
                yield _distinct(row.column("chunk")[0].as_py(), h, doc)

    return lambda batches: _gathered(found(batches), _blobs(parts))


#: chunk is -1, and local has places: a row holds what several chunks have.
SEGMENTS = "part int, chunk int, doc binary, local binary, start binary, windows binary, bytes binary, alias binary, alias_start binary, stop binary"
REMOVED = "chunk int, local binary, start binary, stop binary"


def _removed_rows(chunk: np.ndarray, local: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Table:
    order = np.argsort(chunk, kind="stable")
    edges = _edges(chunk[order])
    return pa.table({"chunk": pa.array(chunk[order][edges[:-1]], pa.int32()), **{name: _cells(x[order], edges) for name, x in (("local", local), ("start", start), ("stop", stop))}})


def _segments_of(row: pa.RecordBatch, parts: int) -> dict[str, np.ndarray]:
    """Segments of a chunk's shared anchors with the parts they are dealt to; those that a smaller document of the chunk holds too are removed."""
    pool, hot, windows = (_pool(row, name) for name in ("h", "hot", "w"))
    c = Chunk(row.select(CHUNK_NAMES).to_pylist()[0])
    place = row.column("chunk")[0].as_py() << LOCAL_BITS
    h, w0, w1, doc = c.anchors()
    keep = _within(pool, h)
    wh, at, _ = _hot_windows(c, h, w0, w1, doc, hot)
    mine = np.argsort(at := at[_within(windows, wh)], kind="stable")
    lh, l0, l1 = long_anchors(c.buf, at[mine])
    of = np.searchsorted(c.first, l0, side="right") - 1
    h, w0, w1, doc = (np.concatenate([x[keep], y]) for x, y in ((h, lh), (w0, l0), (w1, l1), (doc, of)))
    size = w1 - w0 + LENGTH
    # equal segments by their bytes, padded to one width
    same = _same(_padded(_gather(c.buf, w0, size), size))
    ids, start = c.ids[doc], w0 - c.first[doc]
    order = np.lexsort((start, ids, same))
    edges = _edges(same[order])
    lead = np.repeat(order[edges[:-1]], np.diff(edges))
    later = ids[order] > ids[lead]
    gone = order[later]
    of, begin, stop = _merged(doc[gone], start[gone], start[gone] + size[gone]) if len(gone) else (gone, gone, gone)
    # further places of a segment in its least document go along as aliases
    more = ~later & (order != lead)
    extra, first = order[more], order[edges[:-1]]
    spot = np.empty(len(h), np.int64)
    spot[first] = np.arange(len(first))
    return {
        "buf": c.buf, "part": (mix64(h[first]) % np.uint64(parts)).astype(np.int32), "doc": ids[first], "local": doc[first] + place, "start": start[first], "windows": (w1 - w0 + 1)[first].astype(np.uint8), "at": w0[first],
        "alias": spot[lead[more]], "alias_local": doc[extra] + place, "alias_start": start[extra], "gone": of + place, "gone_start": begin, "gone_stop": stop,
    }


def _deal_segments(held: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The segments of several chunks by part, in batches of some MB; part -1: what is removed."""
    get = lambda name: np.concatenate([x[name] for x in held])
    behind = lambda name: np.cumsum([0] + [len(x[name]) for x in held[:-1]])
    moved = lambda name, by: np.concatenate([x[name] + n for x, n in zip(held, behind(by), strict=True)])
    names = [x.split()[0] for x in SEGMENTS.split(", ")]
    batch = lambda **x: pa.RecordBatch.from_arrays([x[n] for n in names], names=names)
    part, buf = get("part"), get("buf")
    order = np.argsort(part, kind="stable")
    part = part[order]
    edges = _edges(part)
    at, doc, local, start, windows = (x[order] for x in (moved("at", "buf"), get("doc"), get("local"), get("start"), get("windows")))
    size = windows.astype(np.int64) + LENGTH - 1
    reach = np.concatenate([[0], np.cumsum(size)])[edges]
    spot = np.empty(len(order), np.int64)
    spot[order] = np.arange(len(order))
    alias = spot[moved("alias", "part")]
    by_spot = np.argsort(alias, kind="stable")
    alias = alias[by_spot]
    alias_edges = np.searchsorted(alias, edges)
    pairs = np.stack([alias - np.repeat(edges[:-1], np.diff(alias_edges)), get("alias_local")[by_spot]], axis=1).ravel()
    alias_start = get("alias_start")[by_spot]
    i = 0
    while i < len(edges) - 1:
        j = max(i + 1, int(np.searchsorted(reach, reach[i] + DEALT, side="right")) - 1)
        own, places = edges[i : j + 1], alias_edges[i : j + 1]
        data = _gather(buf, at[own[0] : own[-1]], size[own[0] : own[-1]])
        yield batch(
            part=pa.array(part[own[:-1]]), chunk=pa.array(np.full(j - i, -1, np.int32)), doc=_cells(doc, own), local=_cells(local, own), start=_cells(start, own), windows=_cells(windows, own),
            bytes=_cells(data, reach[i : j + 1] - reach[i]), alias=_cells(pairs, 2 * places), alias_start=_cells(alias_start, places), stop=pa.array([b""] * (j - i), pa.binary()),
        )
        i = j
    if len(gone := get("gone")):
        lone = {name: _cells(x, np.array([0, len(gone)])) for name, x in (("local", gone), ("start", get("gone_start")), ("stop", get("gone_stop")))}
        none = pa.array([b""], pa.binary())
        yield batch(**{name: none for name in names} | lone | {name: pa.array([-1], pa.int32()) for name in ("part", "chunk")})


def _segments(parts: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
        for row in sliced(batches, 1):
            if len(_pool(row, "h")) + len(_pool(row, "w")):
                out = _segments_of(row, parts)
                yield sum(x.nbytes for x in out.values()), out

    return lambda batches: _gathered(found(batches), _deal_segments)


def _removed_runs(data: np.ndarray, windows: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, stop) of what is removed in segments of so many strings each, by sorting their suffixes."""
    size = windows + LENGTH - 1
    # a separator after each segment
    head = np.cumsum(size + 1) - (size + 1)
    text, inside = np.zeros(int((size + 1).sum()), np.uint8), np.ones(int((size + 1).sum()), bool)
    inside[head + size] = False
    text[inside] = data
    seg = np.repeat(np.arange(len(windows)), windows)
    within = np.arange(len(seg)) - np.repeat(np.cumsum(windows) - windows, windows)
    gone = repeated(text, inside, head[seg] + within, doc[seg])
    seg, within = seg[gone], within[gone]
    fresh = np.concatenate([[True], (seg[1:] != seg[:-1]) | (within[1:] != within[:-1] + 1)])[: len(seg)]
    last = np.concatenate([fresh[1:], [True]])[: len(seg)]
    return seg[fresh], within[fresh], within[last] + LENGTH


def _sort_part(group: pa.Table) -> pa.Table:
    """What is removed in the segments of one part."""
    get = lambda name, kind=np.int64: _flat(group.column(name), kind)
    doc, counts = get("doc")
    chunk = np.repeat(group.column("chunk").to_numpy(), counts).astype(np.int64)
    local, start = get("local")[0], get("start")[0]
    windows = get("windows", np.uint8)[0].astype(np.int64)
    size, data = windows + LENGTH - 1, get("bytes", np.uint8)[0]
    # what several chunks sent stays for its smallest document; in the others it is removed as a whole
    same = _same(_padded(data, size))
    order = np.lexsort((doc, same))
    fresh = np.flatnonzero(np.concatenate([[True], same[order][1:] != same[order][:-1]])) if len(order) else order
    lead = np.repeat(order[fresh], np.diff([*fresh, len(order)]))
    stays = np.ones(len(doc), bool)
    stays[order[doc[order] > doc[lead]]] = False
    sent, again = np.flatnonzero(stays), np.flatnonzero(~stays)
    seg, begin, stop = _removed_runs(data[np.repeat(stays, size)], windows[sent], doc[sent])
    seg, begin, stop = np.concatenate([sent[seg], again]), np.concatenate([begin, np.zeros(len(again), np.int64)]), np.concatenate([stop, size[again]])
    if not len(seg):
        return _removed_rows(*[np.zeros(0, np.int64)] * 4)
    order = np.argsort(seg, kind="stable")
    seg, begin, stop = seg[order], begin[order], stop[order]
    out = [(chunk[seg], local[seg], start[seg] + begin, start[seg] + stop)]
    alias, width = get("alias")
    alias = alias.reshape(-1, 2)
    of = alias[:, 0] + np.repeat(np.cumsum(counts) - counts, width // 2)
    if len(of):
        alias_local, alias_start = alias[:, 1], get("alias_start")[0]
        lo, hi = np.searchsorted(seg, of), np.searchsorted(seg, of, side="right")
        times = hi - lo
        pick = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        at = np.repeat(alias_start, times)
        out.append((chunk[seg[pick]], np.repeat(alias_local, times), at + begin[pick], at + stop[pick]))
    return _removed_rows(*(np.concatenate(x) for x in zip(*out, strict=True)))


def _by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What several parts found, by chunk."""

    def found() -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in sliced(batches, 16):
            yield batch.nbytes, batch

    def deal(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, start, stop = (_flat(pa.chunked_array([x.column(name) for x in held]), np.int64)[0] for name in ("local", "start", "stop"))
        yield from _removed_rows(place >> LOCAL_BITS, place & ((1 << LOCAL_BITS) - 1), start, stop).to_batches()

    return _gathered(found(), deal)


def _cut(chunks: pa.Table, removed: pa.Table) -> pa.Table:
    """(doc_id, sha, n_removed, n_spans, kept) of a chunk's documents."""
    out: list[tuple] = []
    if chunks.num_rows:
        c = Chunk(chunks.to_pylist()[0])
        doc, start, stop = (_flat(removed.column(name), np.int64)[0] for name in ("local", "start", "stop"))
        if len(doc):
            doc, start, stop = _merged(doc, start, stop)
        lo, hi = np.searchsorted(doc, np.arange(len(c.ids))), np.searchsorted(doc, np.arange(len(c.ids)), side="right")
        for i, doc_id in enumerate(c.ids):
            raw = c.buf[c.first[i] : c.first[i] + c.sizes[i]]
            spans = list(zip(start[lo[i] : hi[i]].tolist(), stop[lo[i] : hi[i]].tolist(), strict=True))
            kept, at = [], 0
            for a, b in spans:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            out.append((doc_id, c.shas[32 * i : 32 * i + 32].hex(), sum(b - a for a, b in spans), len(spans), b"".join(x.tobytes() for x in kept)))
    columns = list(zip(*out, strict=True)) or [[]] * 5
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    return pa.table([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["doc_id", "sha", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row of ``docs(doc_id, text)``.

    kept holds the remaining bytes, or with ``digest`` their SHA-256 in
    lowercase hex, which spares a shuffle of all texts. A null text counts as
    empty. A row with a null doc_id keeps all bytes and takes none from others.
    Rows of one doc_id take nothing from each other; repeated rows give repeated
    results; an empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named = docs.where("doc_id IS NOT NULL").withColumn("sha", F.sha2("text", 256))
    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    rows = scratch.keep(named.select("doc_id", "sha", n_bytes))
    least = scratch.keep(rows.groupBy("sha").agg(F.min("doc_id").alias("least"), F.max("n_bytes").alias("size")))
    total = least.agg(F.sum("size")).first()[0] or 0
    chunks, anchor_parts = max(16, -(-total // CHUNK)), max(16, -(-total // (14 * ANCHORS_PART)))
    chunk = lambda c: F.pmod(F.xxhash64(c), F.lit(chunks)).cast("int").alias("chunk")
    chosen = least.select(F.col("least").alias("doc_id"), "sha", chunk("least"))
    dealt = named.select("doc_id", "sha", "text", chunk("doc_id"))
    packed = scratch.keep(dealt.groupBy("chunk").cogroup(chosen.groupBy("chunk")).applyInArrow(_pack, CHUNK_SCHEMA))
    blobs = packed.mapInArrow(_anchor_blobs(anchor_parts), BLOBS)
    shared = scratch.keep(blobs.groupBy("part").applyInArrow(_shared(HOT_CHUNKS), SHARED).mapInArrow(_flags, FLAGS))
    sizes = shared.agg(F.sum(F.octet_length("h")).alias("h"), F.sum(F.octet_length("hot")).alias("hot")).first()
    flags, made = shared, [shared]
    if sizes.hot:
        blobs = _with_flags(packed, shared.where(F.octet_length("hot") > 0)).mapInArrow(_window_blobs(anchor_parts), BLOBS)
        made.append(scratch.keep(blobs.groupBy("part").applyInArrow(_shared(None), SHARED).mapInArrow(_flags, FLAGS)))
        flags = shared.unionByName(made[1])
    parts = max(16, -(-(flags.agg(F.sum(F.octet_length("h") + F.octet_length("w"))).first()[0] or 0) * 9 // PART))
    segments = scratch.keep(_with_flags(packed, flags).mapInArrow(_segments(parts), SEGMENTS))
    scratch.drop(*made)
    sorted_parts = segments.where("part >= 0").groupBy("part").applyInArrow(_sort_part, REMOVED)
    removed = scratch.keep(sorted_parts.unionByName(segments.where("part < 0").select("chunk", "local", "start", "stop")).mapInArrow(_by_chunk, REMOVED))
    scratch.drop(segments)
    cut = packed.groupBy("chunk").cogroup(removed.groupBy("chunk")).applyInArrow(_cut, "doc_id long, sha string, n_removed long, n_spans long, kept binary")
    final = (lambda c: F.sha2(c, 256)) if digest else (lambda c: c)
    cut = cut.select(F.col("doc_id").alias("least"), "sha", "n_removed", "n_spans", final(F.col("kept")).alias("kept"))
    if digest:
        cut = scratch.keep(cut)
        scratch.drop(packed, removed)
    with_least = rows.join(least.select("sha", "least"), "sha")
    copy = (F.col("doc_id") > F.col("least")) & (F.col("n_bytes") >= LENGTH)
    nothing, zero = F.lit(b""), F.lit(0).cast("long")
    columns = "doc_id", "n_bytes", "n_removed", "n_spans", "kept"
    firsts = with_least.where(~copy).join(cut, ["sha", "least"]).select(*columns)
    copies = with_least.where(copy).select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), final(nothing).alias("kept"))
    unnamed = docs.where("doc_id IS NULL").select("doc_id", n_bytes, zero.alias("n_removed"), zero.alias("n_spans"), final(F.encode("text", "UTF-8")).alias("kept"))
    return firsts.unionByName(copies).unionByName(unnamed)


def query(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, digest=True).withColumnRenamed("kept", "kept_sha256")
