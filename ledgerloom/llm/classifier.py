"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage of every text is encoded by its
characters; a hidden layer represents it; gated attention, learned from the
documents' labels alone, weighs the passages; the weighted sum is scored by a
logistic layer.

The model is fitted on the driver from a bounded sample of labelled documents
(``SAMPLE_DOCS``), all passages of each; scoring covers all passages of all
documents. A passage is encoded from its own bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ledgerloom.plans.shipping import ship

from .common import sliced

SAMPLE_DOCS = 6000
#: Bytes of a passage at most (a text's passages are of equal length), and slots for the strings seen in one.
PASSAGE, SLOTS = 2048, 4096
HIDDEN, ATTENTION, EPOCHS, BATCH, RATE = 24, 16, 40, 64, 0.01
#: Bytes encoded at once, and rows taken from a batch at once: what a task holds in memory.
CHUNK, ROWS = 500_000, 256

_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",;:", b"!?", b"#*$%&~^@", b"|", b"<>{}[]()=\\/", b"'\"`", b"-_+"]
N_CLASSES = len(_GROUPS) + 2
CLASS = np.full(256, len(_GROUPS), np.int64)  # other ASCII
CLASS[128:] = len(_GROUPS) + 1
for _k, _group in enumerate(_GROUPS):
    CLASS[list(_group)] = _k
FEATURES = N_CLASSES + 7


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and each text's first passage. An empty text is one passage of zeros."""
    raw = [t.encode() for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    n_passages = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate([[0], np.cumsum(n_passages)[:-1]]).astype(np.int64)
    within = np.arange(int(n_passages.sum())) - np.repeat(first, n_passages)
    size, n = np.repeat(sizes, n_passages), np.repeat(n_passages, n_passages)
    lengths = size * (within + 1) // n - size * within // n
    buf = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum(lengths)
    out, at = [], 0
    while at < len(lengths):
        begin = int(ends[at] - lengths[at])
        upto = max(at + 1, int(np.searchsorted(ends, begin + CHUNK, side="right")))
        out.append(_features(buf[begin : int(ends[upto - 1])], lengths[at:upto]))
        at = upto
    return np.concatenate(out) if out else np.zeros((0, FEATURES), np.float32), first


def _distinct(passage: np.ndarray, grams: np.ndarray, inside: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Distinct strings of each passage, against as many random ones."""
    seen = np.zeros(len(length) * SLOTS, bool)
    seen[passage[inside] * SLOTS + (grams[inside] >> np.uint32(20))] = True
    return seen.reshape(-1, SLOTS).sum(axis=1) / np.maximum(1, SLOTS * (1 - np.exp(-length / SLOTS)))


def _features(buf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Features of passages that lie one after the other in ``buf``, each from its own bytes."""
    total = len(length)
    out = np.zeros((total, FEATURES), np.float32)
    if not len(buf):
        return out
    passage = np.repeat(np.arange(total), length)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(buf))  # bytes to the passage's end
    kind = CLASS[buf]
    counts = np.bincount(passage * N_CLASSES + kind, minlength=total * N_CLASSES).reshape(total, N_CLASSES)
    whole = np.maximum(1, length)
    out[:, :N_CLASSES] = counts / whole[:, None]
    letter = (kind < 2) | (kind == N_CLASSES - 1)
    ends = np.flatnonzero(letter[:-1] & ~letter[1:] & (left[:-1] > 1))
    words = np.bincount(passage[ends], minlength=total)
    odd = np.bincount(passage[ends[(kind[ends + 1] == 8) | (kind[ends + 1] == 7)]], minlength=total)
    out[:, N_CLASSES] = counts[:, [0, 1, N_CLASSES - 1]].sum(axis=1) / np.maximum(1, words) / 10
    out[:, N_CLASSES + 1] = odd / np.maximum(1, words)
    wide = buf.astype(np.uint32)
    gram = wide.copy()
    for shift in (1, 2, 3):
        gram[:-shift] = gram[:-shift] * np.uint32(0x01000193) ^ wide[shift:]
    eight = gram.copy()
    eight[:-4] = gram[:-4] * np.uint32(0x85EBCA6B) ^ gram[4:]
    out[:, N_CLASSES + 2] = _distinct(passage, gram * np.uint32(0x9E3779B1), left > 3, whole)
    out[:, N_CLASSES + 3] = _distinct(passage, eight * np.uint32(0x9E3779B1), left > 7, whole)
    space = counts[:, 3] + counts[:, 4]
    out[:, N_CLASSES + 4] = np.log1p(space) / 5
    out[:, N_CLASSES + 5] = counts[:, 4] / np.maximum(1, space)
    out[:, N_CLASSES + 6] = length / PASSAGE
    return out


class Model:
    """tanh hidden layer, gated attention over a bag's passages, logistic score."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.parts = parts

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p = self.parts
        sizes = np.diff([*first, len(x)])
        x = np.clip((x - p["mean"]) / p["scale"], -5, 5)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), sizes))
        a = e / np.repeat(np.add.reduceat(e, first), sizes)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "y": y, "sizes": sizes}

    def score(self, texts: list[str]) -> np.ndarray:
        """Scores of texts; what is held beside their features is bounded, however long they are."""
        return self.forward(*encode(texts))["y"] if texts else np.zeros(0)


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Learn from feature arrays (passages x features) and 0/1 labels. Without both labels, the model gives their mean."""
    rng = np.random.default_rng(seed)
    n_features = bags[0].shape[1] if bags else FEATURES
    whole = np.concatenate(bags) if bags else np.zeros((1, n_features))
    p = {"mean": whole.mean(axis=0), "scale": whole.std(axis=0) + 1e-3}
    for name, shape in (("W", (n_features, HIDDEN)), ("V", (HIDDEN, ATTENTION)), ("U", (HIDDEN, ATTENTION)), ("w", (ATTENTION,)), ("c", (HIDDEN,))):
        p[name] = rng.normal(0, shape[0] ** -0.5, shape)
    mean = float(np.mean(labels)) if len(labels) else 0.5
    p["b"], p["d"] = np.zeros(HIDDEN), np.array(np.log((mean + 1e-3) / (1 - mean + 1e-3)))
    model = Model(p)
    if not 0 < mean < 1:
        p["c"] = np.zeros(HIDDEN)
        return model
    learned = ["W", "b", "V", "U", "w", "c", "d"]
    m, v, step = {k: 0.0 for k in learned}, {k: 0.0 for k in learned}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            x = np.concatenate([bags[i] for i in chosen])
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in chosen])[:-1]])
            f = model.forward(x, first)
            dy = (f["y"] - labels[chosen]) / len(chosen)
            dz = dy[:, None] * p["c"]
            dzr = np.repeat(dz, f["sizes"], axis=0)
            da = (dzr * f["h"]).sum(axis=1)
            de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first), f["sizes"]))
            dt, dg = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
            dh = (f["a"][:, None] * dzr + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
            grads = {"W": f["x"].T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ dy, "d": dy.sum()}
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) + 1e-4
            for k in learned:
                grad = grads[k] + 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out() -> Column:
    """True for rows from which nothing is learned; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on labelled rows that are not held out: at most ``sample_docs`` of ``labels``, least hash of the id first.

    Rows of ``docs`` with equal id and features count once; of ids with many
    different texts at most as many more are taken.
    """
    ship(docs.sparkSession)
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    chosen = usable.select("doc_id", F.col(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "label").limit(sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ROWS):
            bags = [encode([text.as_py() or ""])[0].tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bags, pa.binary()), batch.column(2)], names=["doc_id", "bag", "label"])

    # the sample's bound makes this side small: sample_docs rows of two numbers
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = joined.mapInArrow(run, "doc_id long, bag binary, label int").distinct().orderBy(F.xxhash64("doc_id"), "label", "bag").limit(2 * sample_docs).collect()
    return fit([np.frombuffer(r.bag, np.float32).reshape(-1, FEATURES).astype(np.float64) for r in rows], np.array([r.label for r in rows], float))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with ``score`` from 0 to 1, higher for label 1.

    Null and empty texts are scored as a bag of one empty passage. Repeated
    rows and null ids stay; a column named score is replaced; an empty table
    gives no rows.
    """
    ship(docs.sparkSession)
    docs = docs.drop("score")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, ROWS):
            found = model.score([t or "" for t in part.column(at).to_pylist()])
            yield part.append_column("score", pa.array(np.clip(found, 0, 1), pa.float64()))

    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])
    return docs.mapInArrow(run, schema)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = scored(docs.select(F.col("doc_id").cast("long"), "text"), train(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
