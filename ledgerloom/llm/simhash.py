"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most ``radius`` bits exactly if some value lies
within half the radius of both. Every distinct fingerprint emits all values
within half the radius of it (2081 for radius 4), these are shuffled, and
fingerprints that meet at a value are linked. The values travel as packed
arrays, not as rows: a chunk of fingerprints sends one blob to each bucket of
values. The value space is worked off in ``PASSES`` parts, each written before
the next begins, so that shuffle files on disk stay a part of the whole.

Fingerprints meeting at one value differ by ``radius`` bits at most by the
triangle inequality, so each is linked to the smallest of them only: no pairs
within a group. A bucket sends on a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, local_forest, mix64
from .components import components

WIDTH, RADIUS, SEED = 4, 4, 42
PASSES, CHUNK, BUCKET_VALUES = 6, 512, 750_000
#: Values of one chunk where each fingerprint has few.
CHUNK_VALUES = 500_000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; of the whole word sequence if it is shorter."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()][: max(1, len(words) - width + 1)]
    stops = (ends - 1)[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[i:j], SEED) for i, j in zip(starts, stops, strict=True)], "<u8")


def _majority(hashes: np.ndarray) -> np.ndarray:
    """64-bit words of hashes (shingles x words) to one word each: bits set in over half of the shingles."""
    ones = np.zeros(64 * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), 255 * 64):  # counts up to 255 stay in a byte
        part = np.unpackbits(np.ascontiguousarray(hashes[at : at + 255 * 64]).view(np.uint8), axis=1, bitorder="little")
        whole = len(part) // 255 * 255
        ones += part[:whole].reshape(-1, 255, part.shape[1]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += part[whole:].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def fingerprint(text: str, width: int = WIDTH) -> int:
    """The fingerprint of one text; zero if it has no word."""
    return int(_majority(_shingle_hashes(text, width)[:, None])[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp): fp is the unsigned fingerprint's bits as a signed long. A null text has no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or "", width) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def ball(radius: int, bits: int = 64) -> np.ndarray:
    """All masks of at most ``radius`` of the lower ``bits`` bits."""
    return np.array([sum(1 << b for b in chosen) for n in range(radius + 1) for chosen in combinations(range(bits), n)], np.uint64)


def _emit(part: int, buckets: int, masks: np.ndarray, passes: int):

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(whole), CHUNK):
                values = (whole[at : at + CHUNK, None] ^ masks).ravel()
                mixed = mix64(values)
                mine = np.flatnonzero((mixed >> np.uint64(32)) % np.uint64(passes) == part)
                bucket = ((mixed[mine] & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                mine, bucket = mine[order], bucket[order]
                edges = np.flatnonzero(np.diff(bucket, prepend=-1))
                found = values[mine], (mine % len(masks)).astype(np.uint16)
                blobs = [[x[i:j].tobytes() for i, j in zip(edges, [*edges[1:], len(mine)][: len(edges)], strict=True)] for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edges]), *(pa.array(b, pa.binary()) for b in blobs)], names=["bucket", "v", "m"])

    return run


def meeting(values: np.ndarray, owners: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (fp, smallest fp linked) of the owners that share a value."""
    order = np.argsort(values)
    values = values[order]
    same = values[1:] == values[:-1]
    if not same.any():
        return owners[:0], owners[:0]
    group = np.cumsum(np.concatenate([[True], ~same]))
    keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    group, owners = group[keep], owners[order[keep]]
    first = np.flatnonzero(np.diff(group, prepend=-1))
    least = np.repeat(np.minimum.reduceat(owners, first), np.diff([*first, len(owners)]))
    a, b = owners[owners != least], least[owners != least]
    pairs = np.unique(np.stack([a, b], axis=1), axis=0)
    linked = np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= radius
    return local_forest(pairs[linked, 0], pairs[linked, 1])


def candidates(values: np.ndarray, owners: np.ndarray, radius: int, small: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, large) of the owners that share a value: every pair of a meeting of ``small`` at most, a spanning forest of the larger ones."""
    order = np.argsort(values)
    values, owners = values[order], owners[order]
    group = np.cumsum(np.concatenate([[True], values[1:] != values[:-1]])[: len(values)]) - 1
    count = np.bincount(group)[group] if len(group) else group
    big = count > small
    group, few = group[(count > 1) & ~big], owners[(count > 1) & ~big]
    found = [np.zeros((0, 2), np.uint64)]
    for off in range(1, small):
        at = np.flatnonzero(group[off:] == group[:-off])
        if not len(at):
            break
        found.append(np.stack([np.minimum(few[at], few[at + off]), np.maximum(few[at], few[at + off])], axis=1))
    pairs = np.unique(np.concatenate(found), axis=0)
    a, b = meeting(values[big], owners[big], radius)
    return np.concatenate([pairs[:, 0], a]), np.concatenate([pairs[:, 1], b]), np.concatenate([np.zeros(len(pairs), bool), np.ones(len(a), bool)])


def links(distinct: DataFrame, scratch: Scratch, radius: int = RADIUS, bits: int = 64, passes: int = PASSES, pairs: bool = False) -> DataFrame:
    """Links (a, b) of ``distinct(fp)`` that join the same fingerprints as all pairs within ``radius`` in the lower ``bits``.

    With ``pairs`` they are (a, b, large), as of ``candidates``.
    """
    masks, n = ball(radius // 2, bits), distinct.count()
    buckets = max(16, -(-n * len(masks) // (passes * BUCKET_VALUES)))
    dealt = distinct.select("fp").repartition(max(12, -(-n // (16 * CHUNK))), "fp")

    def collide(group: pa.Table) -> pa.Table:
        values = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("v")])
        owners = values ^ masks[np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in group.column("m")])]
        if pairs:
            a, b, large = candidates(values, owners, radius)
            return pa.table({"a": a.view(np.int64), "b": b.view(np.int64), "large": large})
        a, b = meeting(values, owners, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    found = None
    for part in range(passes):
        blobs = dealt.mapInArrow(_emit(part, buckets, masks, passes), "bucket int, v binary, m binary")
        new = scratch.keep(blobs.groupBy("bucket").applyInArrow(collide, "a long, b long, large boolean" if pairs else "a long, b long"))
        found = new if found is None else found.union(new)
    return found


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs(doc_id, text)``.

    component_id is the smallest doc_id reachable over links of fingerprints
    that differ in at most ``radius`` bits. Texts without a word, null and empty
    ones included, have fingerprint zero and are linked like any other. Rows
    with a null doc_id stay, their id counting for no component; repeated rows
    give repeated results; an empty table gives no rows; other columns are
    ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.keep(fingerprints(docs, width))
    distinct = scratch.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct, scratch, radius), scratch)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.keep(rooted)
    least = scratch.keep(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    classes = scratch.keep(rooted.join(least, "root").select("fp", "component_id"))
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


# --- similar texts: many shorter fingerprints --------------------------------

#: Bits of a text's signature, tables of fingerprints drawn from them, bits of a fingerprint and the distance that links.
SIGNATURE, TABLES, TABLE_BITS, TABLE_RADIUS = 1024, 56, 38, 2
#: Tables whose links come first and join most classes; passes over the values of all tables.
FIRST_TABLES, TABLE_PASSES = 8, 4
SIMILARITY = 0.8
#: Of the signature's bits, texts at the threshold differ in 155 on average (deviation 11.5): up to SURE they are linked,
#: which is wrong for one of 2000 pairs there; up to MOST_APART their shingles are compared, which leaves out one of 10^5.
SURE, MOST_APART = 117, 207
#: So many texts of one fingerprint are paired all with all, and so are the texts of two linked fingerprints if that
#: makes no more than ``SMALL_PAIRS``; the members of larger ones are asked of hubs.
SMALL, SMALL_PAIRS = 32, 1024


def _table_places() -> np.ndarray:
    """The bits of the signature that each table reads: rows of a few fixed permutations, one after the other."""
    need = TABLES * TABLE_BITS
    order = [np.argsort(mix64(np.arange(SIGNATURE, dtype=np.uint64) + np.uint64(SIGNATURE * k + 1))) for k in range(-(-need // SIGNATURE))]
    return np.concatenate(order)[:need].reshape(TABLES, TABLE_BITS)


def signature(text: str, width: int) -> np.ndarray:
    """SimHash of the distinct shingles, ``SIGNATURE`` bits in 64-bit words."""
    hashes = np.unique(_shingle_hashes(text, width))
    salts = mix64(np.arange(1, SIGNATURE // 64 + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return _majority(mix64(hashes[:, None] ^ salts))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, sig array<long>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signature(t.as_py() or "", width).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "sig"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, sig array<long>")


def table_values(texts: DataFrame) -> DataFrame:
    """(least, fp) of ``texts(least, sig)``: ``TABLES`` fingerprints of each, the table's number above the bits."""
    places = _table_places()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")
            rows = np.zeros((batch.num_rows, TABLES, 64), np.uint8)
            rows[:, :, :TABLE_BITS] = bits[:, places]
            fps = np.packbits(rows, axis=2, bitorder="little").view("<u8")[:, :, 0] | (np.arange(TABLES, dtype=np.uint64) << np.uint64(TABLE_BITS))
            least = np.repeat(batch.column(0).to_numpy(), TABLES)
            yield pa.RecordBatch.from_arrays([pa.array(least), pa.array(fps.ravel().view(np.int64))], names=["least", "fp"])

    return texts.select("least", "sig").mapInArrow(run, "least long, fp long")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles array<long>): the hashes of each text's distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(_shingle_hashes(t.as_py() or "", width)).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, shingles array<long>")


def _emit_rooted(part: int, buckets: int, masks: np.ndarray, passes: int):
    """As ``_emit``, with the class of fingerprints that have one: bit 7 of the mask's number tells so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            classed = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            root = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            step = CHUNK_VALUES // len(masks)
            for at in range(0, len(whole), step):
                values = (whole[at : at + step, None] ^ masks).ravel()
                mixed = mix64(values)
                mine = np.flatnonzero((mixed >> np.uint64(32)) % np.uint64(passes) == part)
                bucket = ((mixed[mine] & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                mine, bucket = mine[order], bucket[order]
                owner = at + mine // len(masks)
                flag = classed[owner]
                kind = (mine % len(masks)).astype(np.uint8) | (flag.astype(np.uint8) << np.uint8(7))
                upto, roots = np.concatenate([[0], np.cumsum(flag)]), root[owner[flag]]
                begin = np.flatnonzero(np.diff(bucket, prepend=-1))
                edges = [*zip(begin, [*begin[1:], len(mine)][: len(begin)], strict=True)]
                blobs = [[v[i:j].tobytes() for i, j in edges] for v in (values[mine], kind)] + [[roots[upto[i] : upto[j]].tobytes() for i, j in edges]]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[begin]), *(pa.array(x, pa.binary()) for x in blobs)], names=["bucket", "v", "m", "r"])

    return run


def open_links(nodes: DataFrame, scratch: Scratch, passes: int, pairs: bool) -> DataFrame:
    """Links of ``nodes(fp, root)`` at values where not all that meet are of one class (root; null: of none).

    With ``pairs`` they are all pairs (a, b, ca, cb) of different classes, where a
    fingerprint of one class stands as that class (ca or cb true), else a forest.
    A value lies near no more fingerprints than the ball has masks, so that
    meetings are of 39 at most.
    """
    masks, n = ball(TABLE_RADIUS // 2, TABLE_BITS), nodes.count()
    buckets = max(16, -(-n * len(masks) // (passes * BUCKET_VALUES)))
    dealt = nodes.select("fp", "root").repartition(max(12, -(-n * len(masks) // (8 * CHUNK_VALUES))), "fp")

    def collide(group: pa.Table) -> pa.Table:
        get = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in group.column(name)])
        values, kind, roots = get("v", np.uint64), get("m", np.uint8), get("r", np.int64)
        order = np.argsort(values)
        flag = kind >> np.uint8(7) == 1
        root = np.zeros(len(values), np.int64)
        root[flag] = roots
        values, flag, root = values[order], flag[order], root[order]
        owners = values ^ masks[(kind & np.uint8(127))[order]]
        same = values[1:] == values[:-1]
        differ = same & ~(flag[1:] & flag[:-1] & (root[1:] == root[:-1]))
        group_of = np.cumsum(np.concatenate([[True], ~same])[: len(values)]) - 1
        is_open = np.zeros(len(values), bool)
        is_open[np.flatnonzero(differ) + 1] = True
        open_groups = np.zeros(int(group_of[-1]) + 1 if len(values) else 0, bool)
        open_groups[group_of[is_open]] = True
        keep = open_groups[group_of]
        if pairs:
            a, b, _ = candidates(values[keep], owners[keep], TABLE_RADIUS, len(masks))
            known, at = np.unique(owners[keep], return_index=True)
            x, y = (at[np.searchsorted(known, end)] for end in (a, b))
            flag, root = flag[keep], root[keep]
            differ = ~(flag[x] & flag[y] & (root[x] == root[y]))
            ends = [np.stack([flag[at], np.where(flag[at], root[at], end.view(np.int64))], axis=1)[differ] for at, end in ((x, a), (y, b))]
            swap = (ends[0][:, 0] < ends[1][:, 0]) | ((ends[0][:, 0] == ends[1][:, 0]) & (ends[0][:, 1] > ends[1][:, 1]))
            both = np.where(swap[:, None], np.hstack(ends[::-1]), np.hstack(ends))  # a class before a fingerprint
            both = np.unique(both, axis=0)
            return pa.table({"a": both[:, 1], "b": both[:, 3], "ca": both[:, 0] == 1, "cb": both[:, 2] == 1})
        else:
            a, b = meeting(values[keep], owners[keep], TABLE_RADIUS)
            known, at = np.unique(owners[keep], return_index=True)
            x, y = (at[np.searchsorted(known, end)] for end in (a, b))
            flag, root = flag[keep], root[keep]
            differ = ~(flag[x] & flag[y] & (root[x] == root[y]))  # those of one class are joined by it
            a, b = a[differ], b[differ]
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    found = None
    for part in range(passes):
        blobs = dealt.mapInArrow(_emit_rooted(part, buckets, masks, passes), "bucket int, v binary, m binary, r binary")
        new = scratch.keep(blobs.groupBy("bucket").applyInArrow(collide, "a long, b long, ca boolean, cb boolean" if pairs else "a long, b long"))
        found = new if found is None else found.union(new)
    return found


def similar(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, component_id): classes of texts whose shingle sets are similar, 0.8 or more in Jaccard's measure.

    At that similarity about 15% of SimHash's bits differ, so one 64-bit
    fingerprint within four bits would miss nearly all such pairs. Each of 56
    fingerprints of 38 bits, drawn from a signature of 1024, is within two bits
    for every sixteenth pair at least, so that nine of ten pairs at the
    threshold, and more above it, meet in some table. Candidates that the whole
    signatures neither confirm nor rule out are decided by their shingle sets.

    Classes grow in three steps, so that large groups of copies make no pairs
    within: texts with an equal fingerprint are asked of the first of them; then
    classes that meet in the first tables are asked of each other once; last,
    all tables are searched for meetings between different homes. A home is a
    class with the texts of no class that it met before (``_homes``): all in it
    are measured in the class's frame (``_framed``), as are others that it meets,
    so that edits of one text meet each other without making pairs. Texts without
    a home are measured pair by pair. Where two fingerprints that meet have many
    texts of several homes, hubs are asked, new ones in each round until these
    texts are one class or all were hubs.

    Rows with a null doc_id are left out; texts without a word are one class. A
    text meets n * 56 * 742 / 2^38 strangers among n others: 15 for 10^8 texts,
    each one a pair of signatures to compare. For more, longer fingerprints in
    more tables keep that low: 48 bits in 150 tables find as many pairs.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    sigs = scratch.keep(signatures(docs.where("doc_id IS NOT NULL"), width))
    texts = scratch.keep(sigs.groupBy("sig").agg(F.min("doc_id").alias("least")))
    values = scratch.keep(table_values(texts))
    nodes = scratch.keep(values.groupBy("fp").agg(F.min("least").alias("first"), F.count("*").alias("n")))

    # equal fingerprints
    equal = values.join(nodes.where("n > 1").select("fp", "first"), "fp").select(F.col("least").alias("a"), F.col("first").alias("b"))
    linked = _verified(equal, docs, texts, scratch, width)
    roots = scratch.keep(components(linked, scratch))

    def rooted(roots: DataFrame) -> DataFrame:
        """(fp, first, n, root): the class of each fingerprint's texts, null if they are of none or of several."""
        classed = texts.join(roots.select(F.col("node").alias("least"), "root"), "least").select(F.col("root").alias("least"), "sig")
        of = table_values(classed).groupBy("fp").agg(F.min("least").alias("low"), F.max("least").alias("high"), F.count("*").alias("c"))
        one = (F.col("low") == F.col("high")) & (F.col("c") == F.col("n"))
        return scratch.keep(nodes.join(of, "fp", "left").select("fp", "first", "n", F.when(one, F.col("low")).alias("root")))

    # neighbours in the first tables: two classes, or texts of none, are asked once, at one of their meetings
    classed = rooted(roots)
    some = classed.where(F.shiftright("fp", TABLE_BITS) < FIRST_TABLES)
    near = open_links(some, scratch, 1, pairs=False)
    end = lambda x: some.select(F.col("fp").alias(x), F.col("first").alias(f"d{x}"), F.coalesce("root", "first").alias(f"r{x}"))
    asked = near.distinct().join(end("a"), "a").join(end("b"), "b").where("ra != rb")
    asked = asked.groupBy(F.least("ra", "rb").alias("ra"), F.greatest("ra", "rb").alias("rb")).agg(F.min(F.struct("da", "db")).alias("d"))
    asked = scratch.keep(asked.select(F.col("d.da").alias("a"), F.col("d.db").alias("b")))
    new = _verified(asked, docs, texts, scratch, width)
    linked = scratch.keep(linked.union(new).distinct())
    roots = scratch.keep(components(_star(roots).union(new), scratch))
    scratch.drop(classed)

    # all neighbours of different homes
    homes = _homes(asked, linked, roots, texts, scratch)
    classed = rooted(homes)
    near = open_links(classed, scratch, TABLE_PASSES, pairs=True)
    near = scratch.keep(near.distinct())
    mixed = classed.where("n > 1 AND root IS NULL")
    touched = near.where("NOT ca").select(F.col("a").alias("fp")).union(near.where("NOT cb").select("b")).union(mixed.select("fp")).distinct()
    touched = scratch.keep(touched)
    counts = scratch.keep(classed.join(touched, "fp", "left_semi").select("fp", "n", "root"))
    mine = values.join(touched, "fp", "left_semi").join(homes.withColumnRenamed("node", "least"), "least", "left")
    mine = scratch.keep(mine.select("fp", "least", F.coalesce("root", "least").alias("root")))
    scratch.drop(values, nodes, classed)
    alone = near.where("NOT ca").join(counts.select(F.col("fp").alias("a"), F.col("n").alias("na")), "a").join(counts.select(F.col("fp").alias("b"), F.col("n").alias("nb")), "b")
    alone = alone.select("a", "b", (F.col("na") * F.col("nb") <= SMALL_PAIRS).alias("few"))

    # Homes that met, and crowds: the texts of one or two fingerprints, where these are too many.
    mixed = counts.where("n > 1 AND root IS NULL").select(F.col("fp").alias("a"), F.col("fp").alias("b"), (F.col("n") <= SMALL).alias("few"))
    met = scratch.keep(alone.unionByName(mixed))
    own = scratch.keep(mine.select("fp", "root").distinct())
    owner = lambda x: own.select(F.col("fp").alias(x), F.col("root").alias(f"r{x}"))
    pairs = met.where("few").join(owner("a"), "a").join(owner("b"), "b").select("ra", "rb")
    pairs = pairs.union(near.where("ca AND NOT cb").join(owner("b"), "b").select("a", "rb")).union(near.where("cb").select("a", "b"))
    pairs = scratch.keep(pairs.where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    crowded = met.where("NOT few").select(F.struct("a", "b").alias("crowd"), F.explode(F.array("a", "b")).alias("fp"))
    members = scratch.keep(crowded.join(mine, "fp").select("crowd", F.col("least").alias("text")).distinct())
    pairs = _framed(pairs, linked, roots, homes, docs, texts, scratch, width)

    new = _verified(pairs, docs, texts, scratch, width)
    linked = scratch.keep(linked.union(new).distinct())
    roots = scratch.keep(components(_star(roots).union(new), scratch))
    scratch.drop(mine, own, met, counts, near, touched)
    turn = 0
    while True:
        placed = members.join(roots.withColumnRenamed("node", "text"), "text", "left").select("crowd", "text", F.coalesce("root", "text").alias("root"))
        placed = scratch.keep(placed)
        split = placed.groupBy("crowd").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("crowd")
        placed = scratch.keep(placed.join(split, "crowd", "left_semi"))
        if placed.isEmpty():
            break
        hubs = _hubs(placed, linked, turn, scratch)
        asked = placed.join(hubs.select("crowd", F.col("text").alias("hub"), F.col("root").alias("of")), "crowd").where("root != of").select(F.col("text").alias("a"), F.col("hub").alias("b"))
        new = _verified(asked, docs, texts, scratch, width)
        members = scratch.keep(placed.join(hubs.select("crowd", "text"), ["crowd", "text"], "left_anti").select("crowd", "text"))
        if not new.isEmpty():
            linked = scratch.keep(linked.union(new).distinct())
            roots = scratch.keep(components(_star(roots).union(new), scratch))
        turn += 1
    rooted_texts = scratch.keep(texts.join(roots.withColumnRenamed("node", "least"), "least", "left").select("sig", "least", F.coalesce("root", "least").alias("root")))
    first = scratch.keep(rooted_texts.groupBy("root").agg(F.min("least").alias("component_id")))
    classes = scratch.keep(rooted_texts.join(first, "root").select("sig", "component_id"))
    return sigs.join(classes, "sig").select("doc_id", "component_id")


def _apart(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, a: n + a)


def _star(roots: DataFrame) -> DataFrame:
    """Links (a, b) that join the classes of ``roots(node, root)``, one for each text."""
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def _centres(members: DataFrame, linked: DataFrame, texts: DataFrame) -> DataFrame:
    """(frame, centre, csig): of the ``members(frame, text)`` of a class the one with the most links."""
    degrees = linked.select(F.col("a").alias("text")).union(linked.select("b")).groupBy("text").agg(F.count("*").alias("links"))
    centres = members.join(degrees, "text", "left").groupBy("frame").agg(F.max(F.struct("links", "text"))["text"].alias("centre"))
    return centres.join(texts.select(F.col("least").alias("centre"), F.col("sig").alias("csig")), "centre")


def _reach(members: DataFrame, centres: DataFrame, texts: DataFrame) -> DataFrame:
    """(frame, radius): the most bits that one of the ``members(frame, text)`` is apart from the centre."""
    wide = members.join(texts.select(F.col("least").alias("text"), "sig"), "text").join(centres, "frame")
    return wide.groupBy("frame").agg(F.max(_apart("sig", "csig")).alias("radius"))


def _homes(asked: DataFrame, linked: DataFrame, roots: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): ``roots`` with texts of no class added to the largest class that they were asked of and may be similar to.

    ``asked(a, b)`` are the pairs of texts that were asked.
    """
    either = asked.select(F.col("a").alias("text"), F.col("b").alias("node")).union(asked.select("b", "a"))
    guests = either.join(roots.select(F.col("node").alias("text")), "text", "left_anti").join(roots, "node").select("text", F.col("root").alias("frame"))
    guests = scratch.keep(guests.distinct())
    members = scratch.keep(roots.select(F.col("root").alias("frame"), F.col("node").alias("text")).join(guests.select("frame").distinct(), "frame", "left_semi"))
    centres = scratch.keep(_centres(members, linked, texts))
    reach = centres.join(_reach(members, centres, texts), "frame").join(members.groupBy("frame").agg(F.count("*").alias("n")), "frame")
    sig = texts.select(F.col("least").alias("text"), "sig")
    near = guests.join(sig, "text").join(scratch.keep(reach), "frame").where(_apart("sig", "csig") <= F.lit(MOST_APART) + F.col("radius"))
    chosen = near.groupBy("text").agg(F.max(F.struct("n", "frame"))["frame"].alias("frame"))
    return scratch.keep(roots.select("node", "root").union(chosen.select("text", "frame")))


def _framed(met: DataFrame, linked: DataFrame, roots: DataFrame, homes: DataFrame, docs: DataFrame, texts: DataFrame, scratch: Scratch, width: int) -> DataFrame:
    """Pairs (a, b) of texts that may be similar, in one of ``homes(node, root)`` or in two (a, b) that met; texts without one stand for themselves.

    Two of these make a pair. A home is a frame of its own texts, and of two that
    met the larger one has the texts of the other as its guests: each text of a
    frame is taken as what it adds to the frame's centre, the text of its class
    with the most links, and what it lacks of it. A class with a text similar to
    the centre is of the frame's class from there on.
    With n shingles, p added and q lacking, texts that share s of the added ones
    differ in p1 + p2 - 2s + |q1 - q2| shingles at least, and similar ones in
    (n1 + n2) / 9 at most. So they share added shingles, by which they are
    joined, and edits made by themselves make no pairs; or they add so little
    that none need be shared, and then one of them is shorter than the centre,
    as one at least is not similar to that. One of n1 shingles has (5 n1 - 4 n2) / 9
    at most that a similar one of n2 has not. So with the frame's rarest shingles
    first, no more of them come before the first that both share, and edits that
    many made, which come last, make no pairs either.
    """
    sizes = scratch.keep(homes.groupBy("root").agg(F.count("*").alias("n")))
    size = lambda x: sizes.select(F.col("root").alias(x), F.col("n").alias(f"n{x}"))
    sized = met.join(size("a"), "a", "left").join(size("b"), "b", "left").fillna(1, ["na", "nb"])
    sized = scratch.keep(sized)
    direct = sized.where("na = 1 AND nb = 1").select("a", "b")
    larger = F.col("na") >= F.col("nb")
    guests = sized.where("na > 1 OR nb > 1").select(F.when(larger, F.col("a")).otherwise(F.col("b")).alias("frame"), F.when(larger, F.col("b")).otherwise(F.col("a")).alias("root"))
    guests = scratch.keep(guests.join(homes, "root", "left").select("frame", F.coalesce("node", "root").alias("text")))

    # centres, and guests that are near enough to them for the home's radius
    lone = homes.join(roots.select("node"), "node", "left_anti").select("root")
    frames = scratch.keep(guests.select("frame").union(lone).distinct())
    inside = scratch.keep(homes.select(F.col("root").alias("frame"), F.col("node").alias("text")).join(frames, "frame", "left_semi"))
    classes = roots.select(F.col("root").alias("frame"), F.col("node").alias("text")).join(frames, "frame", "left_semi")
    centres = scratch.keep(_centres(classes, linked, texts))
    centres = scratch.keep(centres.join(_reach(inside, centres, texts), "frame"))
    sig = texts.select(F.col("least").alias("text"), "sig")
    guests = guests.join(sig, "text").join(centres, "frame").where(_apart("sig", "csig") <= F.lit(MOST_APART) + F.col("radius")).select("frame", "text")
    guests = scratch.keep(guests)
    frames = scratch.keep(guests.select("frame").union(lone).distinct())
    both = guests.union(inside.join(frames, "frame", "left_semi").select("frame", "text"))
    placed = scratch.keep(both.join(roots.withColumnRenamed("node", "text"), "text", "left").select("frame", "text", F.coalesce("root", "text").alias("root")))

    # what each adds to the centre and lacks of it
    asked = scratch.keep(placed.select(F.col("text").alias("doc_id")).distinct())
    sets = scratch.keep(shingle_sets(docs.join(asked, "doc_id", "left_semi"), width).dropDuplicates(["doc_id"]))
    centre_sets = centres.join(frames, "frame", "left_semi").join(sets.select(F.col("doc_id").alias("centre"), F.col("shingles").alias("cs")), "centre")
    centre_sets = scratch.keep(centre_sets.select("frame", "centre", "cs"))
    differ = placed.join(sets.withColumnRenamed("doc_id", "text"), "text").join(centre_sets, "frame")
    differ = differ.select("frame", "centre", "text", "root", F.size("shingles").alias("n"), F.size("cs").alias("nc"), F.array_except("shingles", "cs").alias("added"), F.size(F.array_except("cs", "shingles")).alias("q"))
    differ = scratch.keep(differ.withColumn("p", F.size("added")).withColumn("close", F.col("n") - F.col("p") >= SIMILARITY * (F.col("nc") + F.col("p"))))
    to_centre = differ.where("close AND root != frame").select(F.col("text").alias("a"), F.col("centre").alias("b"))

    # classes of which no text is similar to the centre: by added shingles of more than one class, or without any
    as_centre = differ.where("close AND root != frame").select("frame", "root", F.lit(True).alias("joined")).distinct()
    open_ = differ.join(as_centre, ["frame", "root"], "left").withColumn("root", F.when(F.col("joined"), F.col("frame")).otherwise(F.col("root")))
    open_ = scratch.keep(open_.drop("joined", "close", "centre"))
    elements = scratch.keep(open_.select("frame", "text", "root", "n", "p", F.explode("added").alias("e")))
    counts = scratch.keep(elements.groupBy("frame", "e").agg(F.count("*").alias("f"), F.min("root").alias("low"), F.max("root").alias("high")))
    of_text = Window.partitionBy("frame", "text")
    rank = F.col("p") - F.count("*").over(of_text) + F.row_number().over(of_text.orderBy("f", "e"))  # a text's own come first
    early = elements.join(counts.where("f > 1"), ["frame", "e"]).withColumn("rank", rank).where("low < high AND 5 * (rank - 1) <= n")
    early = scratch.keep(early.select("frame", "e", "text", "root", "n", "rank"))
    of = lambda x, *more: [F.col(c).alias(f"{c}{x}") for c in ("text", "root", *more)]
    side = lambda x: early.select("frame", "e", *of(x, "n", "rank"))
    shared = side(1).where("9 * (rank1 - 1) <= n1").join(side(2), ["frame", "e"]).where("(n1 < n2 OR n1 = n2 AND text1 < text2) AND root1 != root2")
    shared = shared.where("9 * (rank1 - 1) <= 5 * n1 - 4 * n2 AND 9 * (rank2 - 1) <= 5 * n2 - 4 * n1")
    shared = scratch.keep(shared.select("frame", "text1", "text2").distinct())
    counted = open_.select("frame", "text", "root", "n", "nc", "p", "q", "added")
    end = lambda x: counted.select("frame", *of(x, "n", "p", "q", "added"))
    least = "9 * (p1 + p2 + abs(q1 - q2)) - (n1 + n2)"
    shared = shared.join(end(1), ["frame", "text1"]).join(end(2), ["frame", "text2"]).where(f"18 * size(array_intersect(added1, added2)) >= {least}")
    shared = shared.select(F.col("text1").alias("a"), F.col("text2").alias("b"))
    few = scratch.keep(counted.where("4 * p <= n").drop("added"))
    one, other = few.where("n < nc").select("frame", *of(1, "n", "p", "q")), few.select("frame", (F.col("n") < F.col("nc")).alias("short2"), *of(2, "n", "p", "q"))
    free = one.join(other, "frame").where(f"(text1 < text2 OR NOT short2) AND root1 != root2 AND {least} <= 0").select(F.col("text1").alias("a"), F.col("text2").alias("b"))
    found = scratch.keep(direct.union(to_centre).union(shared).union(free))
    scratch.drop(sets, centre_sets, differ, open_, elements, sized)
    return found


def _hubs(placed: DataFrame, linked: DataFrame, turn: int, scratch: Scratch) -> DataFrame:
    """(crowd, text, root): of each crowd's members those with the most and with the fewest links, in 2^turn slots each.

    The text that others were edited from has the most links as soon as two of
    its copies were asked. A hub is asked of every member outside its class and
    then leaves the crowd, so that no pair is left out whoever is chosen.
    """
    degrees = linked.select(F.col("a").alias("text")).union(linked.select("b")).groupBy("text").agg(F.count("*").alias("links"))
    key = F.struct(F.coalesce("links", F.lit(0)).alias("links"), F.xxhash64("text").alias("h"), "text", "root").alias("key")
    slot = F.pmod(F.xxhash64("text", F.lit(turn)), F.lit(1 << min(turn, 30))).alias("slot")
    ends = placed.join(degrees, "text", "left").select("crowd", slot, key).groupBy("crowd", "slot").agg(F.max("key").alias("most"), F.min("key").alias("fewest"))
    chosen = ends.select("crowd", F.explode(F.array("most", "fewest")).alias("key")).select("crowd", "key.text", "key.root")
    return scratch.keep(chosen.distinct())


def _verified(pairs: DataFrame, docs: DataFrame, texts: DataFrame, scratch: Scratch, width: int) -> DataFrame:
    """Those of the pairs (a, b) of texts that are similar: by all their bits, or else by their shingle sets."""
    pairs = scratch.keep(pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    left = texts.select(F.col("least").alias("a"), F.col("sig").alias("sa"))
    right = texts.select(F.col("least").alias("b"), F.col("sig").alias("sb"))
    measured = scratch.keep(pairs.join(left, "a").join(right, "b").select("a", "b", _apart("sa", "sb").alias("apart")).where(F.col("apart") <= MOST_APART))
    unsure = measured.where(F.col("apart") > SURE).select("a", "b")
    asked = scratch.keep(unsure.select(F.col("a").alias("doc_id")).union(unsure.select("b")).distinct())
    sets = scratch.keep(shingle_sets(docs.join(asked, "doc_id", "left_semi"), width).dropDuplicates(["doc_id"]))
    both = unsure.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    decided = both.where(common >= SIMILARITY * (F.size("sa") + F.size("sb") - common)).select("a", "b")
    return scratch.keep(measured.where(F.col("apart") <= SURE).select("a", "b").union(decided))


def query(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
