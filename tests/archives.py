"""A writer of small archives, independent of the decoders under test."""

import gzip
import hashlib
import json
import struct
from pathlib import Path

EMPTY = hashlib.sha256(b"\0\0\0\0").digest()


def sha(*parts):
    return hashlib.sha256(b"".join(parts)).digest()


def u32(x):
    return struct.pack(">I", x)


def framed(*bodies):
    return gzip.compress(b"".join(u32(len(b) | 0x80000000) + b for b in bodies), mtime=0)


def file_path(kind, cp):
    h = f"{cp:08x}"
    return f"{kind}/{h[:2]}/{h[2:4]}/{h[4:6]}/{kind}-{h}.{'json' if kind == 'history' else 'xdr.gz'}"


def bucket_path(h):
    return f"bucket/{h[:2]}/{h[2:4]}/{h[4:6]}/bucket-{h}.xdr.gz"


def header(seq, prev, tx_set, result, upgrades=(), signed=False):
    close = u32(1) + u32(0) + b"k" * 32 + u32(64) + b"s" * 64 if signed else u32(0)
    ups = u32(len(upgrades)) + b"".join(u32(len(u)) + u + b"\0" * (-len(u) % 4) for u in upgrades)
    return b"".join([u32(20), prev, tx_set, struct.pack(">Q", 7), ups, close, result, b"b" * 32, u32(seq), b"\0" * (8 + 8 + 4 + 8 + 4 + 4 + 4), b"\0" * 128, u32(0)])


def i64(x):
    return struct.pack(">q", x)


def i32(x):
    return struct.pack(">i", x)


def text(b):
    return u32(len(b)) + b + b"\0" * (-len(b) % 4)


def first_form(seq, operations=()):
    """A transaction of the first form: source, fee, number, no bounds, no memo."""
    return u32(0) + b"a" * 32 + u32(100) + i64(seq) + u32(0) + u32(0) + u32(len(operations)) + b"".join(operations) + u32(0) + u32(1) + b"hint" + text(b"s" * 64)


def payment(amount):
    return u32(0) + u32(1) + u32(0) + b"d" * 32 + u32(1) + b"EUR\0" + u32(0) + b"i" * 32 + i64(amount)


def second_form(seq, operations=()):
    """A transaction of the second form with time bounds and a text as memo."""
    return u32(2) + u32(256) + i64(5) + b"m" * 32 + u32(100) + i64(seq) + u32(1) + i64(0) + i64(9) + u32(1) + text(b"memo") + u32(len(operations)) + b"".join(operations) + u32(0) + u32(0)


def transactions(seq, prev, general):
    """(entry, hash of the set)"""
    if general:
        whole = u32(1) + prev + u32(1) + u32(0) + u32(1) + u32(0) + u32(1) + i64(100) + u32(1) + second_form(seq, [payment(seq)])
        return u32(seq) + b"\0" * 32 + u32(0) + u32(1) + whole, sha(whole)
    bodies = sorted((first_form(seq, [payment(k)]) for k in range(seq % 3 + 1)), key=sha)
    return u32(seq) + prev + u32(len(bodies)) + b"".join(bodies) + u32(0), sha(prev, *bodies)


def results(seq):
    paid = u32(0) + u32(1) + i32(0 if seq % 2 else -2)
    body = u32(1) + b"r" * 32 + i64(100) + i32(0 if seq % 2 else -1) + u32(1) + paid + u32(0)
    return u32(seq) + body + u32(0), sha(body)


def consensus(seq):
    quorum = u32(2) + u32(1) + u32(0) + b"v" * 32 + u32(0)
    statement = u32(0) + b"v" * 32 + i64(seq) + u32(2) + u32(1) + text(b"value") + u32(1) + b"q" * 32
    return u32(0) + u32(1) + quorum + u32(seq) + u32(1) + statement + text(b"s" * 64)


def state(cp, buckets, version=1):
    zero, done = "0" * 64, {"state": 0}
    levels = [{"curr": b, "snap": zero, "next": done} for b in buckets] + [{"curr": zero, "snap": zero, "next": done}] * (11 - len(buckets))
    out = {"version": version, "server": "test", "currentLedger": cp, "currentBuckets": levels}
    return out | ({"hotArchiveBuckets": levels} if version == 2 else {})


def write(root, path, data):
    target = Path(root) / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(data)


def build(root, checkpoints=3, pointer="root-history.json", tamper=None):
    """Write an archive. ``tamper(seq, hashes)`` may change expected tx and result hashes before the header is hashed."""
    prev = b"\0" * 32
    for k in range(checkpoints):
        cp = 64 * k + 63
        heads, txs, res = [], [], []
        for seq in range(max(1, cp - 63), cp + 1):
            tx_entry, tx_hash = transactions(seq, prev, seq % 2 == 0)
            res_entry, res_hash = results(seq)
            if seq % 7 == 0:  # a ledger without transactions
                tx_hash, res_hash = sha(prev), EMPTY
            else:
                txs.append(tx_entry)
                res.append(res_entry)
            tx_hash, res_hash = tamper(seq, tx_hash, res_hash) if tamper else (tx_hash, res_hash)
            h = header(seq, prev, tx_hash, res_hash, upgrades=(b"up",) if seq % 10 == 0 else (), signed=seq % 3 == 0)
            heads.append(sha(h) + h + u32(0))
            prev = sha(h)
        write(root, file_path("ledger", cp), framed(*heads))
        write(root, file_path("transactions", cp), framed(*txs))
        write(root, file_path("results", cp), framed(*res))
        write(root, file_path("scp", cp), framed(consensus(cp)))
        names = []
        for tag in ("shared", f"own{cp}"):
            raw = f"bucket {tag}".encode() * 50
            names.append(hashlib.sha256(raw).hexdigest())
            write(root, bucket_path(names[-1]), gzip.compress(raw, mtime=0))
        text = json.dumps(state(cp, names)).encode()
        write(root, file_path("history", cp), text)
    write(root, f".well-known/{pointer}", text)
    return 64 * checkpoints - 1


def tree(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in Path(root).rglob("*") if p.is_file()}
