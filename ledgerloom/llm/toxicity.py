"""Toxicity by maximum-scoring segments of token log-odds, calibrated by extreme values.

A token is a run of letters, in lower case; its units are the whole token and its
first three, four and five letters. Log-odds of units between toxic and other
labelled documents use an informative Dirichlet prior (their frequency in both)
and are drawn towards zero by a multiple of their deviation; a token counts with
its best unit, less a drift that makes the expected score of clean text negative.
A linear-time scan finds all maximal-scoring segments of a text. What a segment's
score means follows from extreme-value statistics: in clean text of n tokens,
K n exp(-lambda S) segments score S or more. A text's passages are combined by
the sum statistic of such scores, whose negative logarithm a logistic curve,
fitted on labels, maps to a probability.

Learning uses at most ``SAMPLE_DOCS`` labelled documents, whole texts. Their
counts are summed in Spark in ``SLOTS`` hashed slots, so what the driver holds
does not grow. Lambda, K and the curve are fitted on texts scored with the
log-odds of the other half of the sample. Scoring covers all whole texts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import Scratch, sliced

SAMPLE_DOCS = 20_000
SLOTS = 1 << 20
PREFIXES = (5, 4, 3)
#: Prior documents, deviations that log-odds are drawn in by, and what a token without evidence loses.
PRIOR, DRAWN, DRIFT = 10.0, 2.0, 0.3
#: Scores from here on are the tail that lambda and K are estimated from; expected chance segments of a passage told as significant.
TAIL, SIGNIFICANT = 1.0, 0.01
#: Bins of the sum statistic's logarithm for the fitted curve.
BINS = 256
#: Words whose score a task remembers, rows taken from a batch at once, characters of a text tokenised at once.
REMEMBERED, ROWS, STEP = 500_000, 256, 1 << 20
_TOKEN = re.compile(r"[^\W\d_]+")
_PASSAGE = StructType([StructField("start", LongType()), StructField("stop", LongType()), StructField("score", DoubleType()), StructField("expected", DoubleType())])
_PASSAGES = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))


def tokens(text: str) -> Iterator[tuple[str, int, int]]:
    """(token, start, stop) by code points of the text as given; only what is read is put in lower case."""
    for m in _TOKEN.finditer(text):
        yield m.group().lower(), m.start(), m.end()


def units(word: str) -> list[int]:
    """Slots of a token's units: itself, and the beginnings shorter than it."""
    found = [zlib.crc32(b"=" + word.encode()) & (SLOTS - 1)]
    found += [zlib.crc32(word[:k].encode()) & (SLOTS - 1) for k in PREFIXES if len(word) > k]
    return found


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """Drawn-in log-odds of every slot from document counts of both classes."""
    share = (toxic + clean) / max(1.0, n_toxic + n_clean)
    with np.errstate(divide="ignore", invalid="ignore"):
        with_it = [x + PRIOR * share for x in (toxic, clean)]
        without = [n - x + PRIOR * (1 - share) + 0.5 for x, n in ((toxic, n_toxic), (clean, n_clean))]
        delta = np.log(with_it[0] / without[0]) - np.log(with_it[1] / without[1])
        deviation = np.sqrt(sum(1 / x for x in (*with_it, *without)))
        out = np.sign(delta) * np.maximum(0.0, np.abs(delta) - DRAWN * deviation)
    return np.where(toxic + clean > 0, out, 0.0).astype(np.float32)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, stop, score) of a sequence, in linear time.

    Candidates are kept as (start, stop, sum before, sum at the end); a new one
    is joined with the nearest earlier candidate that begins lower and ends
    lower, along with all between, until none is left to join.
    """
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    held: list[tuple[int, int, float, float, int]] = []  # the last field: the nearest earlier candidate that begins lower
    for at in np.flatnonzero(scores > 0):
        start, stop, left, right = int(at), int(at) + 1, float(total[at]), float(total[at + 1])
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= left:
                j = held[j][4]
            if j < 0 or held[j][3] >= right:
                held.append((start, stop, left, right, j))
                break
            start, left = held[j][0], held[j][2]
            del held[j:]
    return [(start, stop, right - left) for start, stop, left, right, _ in held]


def sum_statistic(scores: list[float], size: int, rate: float, k: float) -> float:
    """-ln of the chance of the best r segments of a text of ``size`` tokens, for the r that is least likely by chance."""
    best, total = 0.0, 0.0
    for r, score in enumerate(sorted(scores, reverse=True), 1):
        total += rate * score - math.log(max(1e-12, k * max(1, size)))
        if total <= 0:
            continue
        chance = -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r)
        best = max(best, -chance - r * math.log(2))  # a factor of two for each further r looked at
    return best


@dataclass
class Model:
    """Log-odds by slot, lambda and K, and the curve's intercept and slope over ln(1 + statistic)."""

    odds: np.ndarray
    rate: float = 1.0
    k: float = 1.0
    intercept: float = 0.0
    slope: float = 0.0

    def __post_init__(self):
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def token_score(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            own = self.odds[units(word)]
            best = float(own[np.argmax(np.abs(own))])
            found = self.known[word] = best - DRIFT
        return found

    def found(self, text: str) -> tuple[list[tuple[int, int, float]], int]:
        """(maximal segments by tokens, number of tokens)."""
        scores: list[np.ndarray] = []
        size = 0
        for piece in self._pieces(text):
            some = [self.token_score(w) for w in _TOKEN.findall(piece.lower())]
            scores.append(np.array(some, np.float32))
            size += len(some)
        return segments(np.concatenate(scores) if scores else np.zeros(0, np.float32)), size

    def significant(self, text: str, found: list[tuple[int, int, float]], size: int) -> list[tuple[int, int, float, float]]:
        """(start, stop, score, expected) by code points of the segments fewer than ``SIGNIFICANT`` of which are expected by chance."""
        told = [(a, b, s, self.expected(s, size)) for a, b, s in found]
        told = [x for x in told if x[3] < SIGNIFICANT]
        at = _places(text, {x for a, b, *_ in told for x in (a, b - 1)}) if told else {}
        return [(at[a][0], at[b - 1][1], s, e) for a, b, s, e in told]

    @staticmethod
    def _pieces(text: str) -> Iterator[str]:
        """The text in pieces of about ``STEP`` characters that part no token."""
        at = 0
        while at < len(text):
            stop = at + STEP
            while stop < len(text) and text[stop - 1].isalpha() and text[stop].isalpha():
                stop += 1
            yield text[at:stop]
            at = stop

    def statistic(self, found: list[tuple[int, int, float]], size: int) -> float:
        return sum_statistic([s for _, _, s in found if s >= TAIL], size, self.rate, self.k)

    def probability(self, statistic: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.intercept + self.slope * math.log1p(statistic)))))

    def expected(self, score: float, size: int) -> float:
        return self.k * max(1, size) * math.exp(-self.rate * score)


def _places(text: str, wanted: set[int]) -> dict[int, tuple[int, int]]:
    """Code points of the tokens asked for by number."""
    out = {}
    for i, m in enumerate(_TOKEN.finditer(text)):
        if i in wanted:
            out[i] = m.span()
    return out


def held_out() -> Column:
    """True for rows from which nothing is learned; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, label: str, sample_docs: int, scratch: Scratch) -> DataFrame:
    """(text, label, fold) of the labelled documents learned from, each different text of an id once."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    chosen = usable.select("doc_id", F.col(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "label").limit(sample_docs)
    # the sample's bound makes this side small: sample_docs rows of two numbers
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    once = joined.groupBy("doc_id", "label", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"))
    return scratch.keep(once.select("text", "label", (F.crc32(F.concat_ws(":", "doc_id", F.lit("fold"))) % 2).cast("int").alias("fold")))


def _counts(sample: DataFrame) -> np.ndarray:
    """Documents by (fold, label, slot), with their number in a slot beyond the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((4, SLOTS + 1), np.int64)
        known: dict[str, list[int]] = {}
        for part in sliced(batches, ROWS):
            for text, label, fold in zip(*(part.column(c) for c in ("text", "label", "fold")), strict=True):
                words = {w for piece in Model._pieces(text.as_py()) for w in _TOKEN.findall(piece.lower())}
                if len(known) > REMEMBERED:
                    known.clear()
                slots: set[int] = {SLOTS}
                for w in words:
                    if w not in known:
                        known[w] = units(w)
                    slots.update(known[w])
                n[2 * fold.as_py() + label.as_py(), list(slots)] += 1
        group, slot = np.nonzero(n)
        for at in range(0, len(group), 1 << 16):
            g, s = group[at : at + (1 << 16)], slot[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(s, pa.int64()), pa.array(n[g, s], pa.int64())], names=["g", "slot", "n"])

    # at most 4 * (SLOTS + 1) rows, however large the sample
    summed = sample.mapInArrow(run, "g long, slot long, n long").groupBy("g", "slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((4, SLOTS + 1))
    out[summed["g"].to_numpy(), summed["slot"].to_numpy()] = summed["n"].to_numpy()
    return out.reshape(2, 2, SLOTS + 1)


def _of(counts: np.ndarray) -> np.ndarray:
    return log_odds(counts[1, :-1], counts[0, :-1], counts[1, -1], counts[0, -1])


def _bin(statistic: float) -> int:
    return min(BINS - 1, int(math.log1p(statistic) * 24))


def _fitted(sample: DataFrame, models: list[Model], of: str) -> list:
    """Sums over the sample, each text scored with the other half's log-odds: of the clean tail, or of labels by bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[float]] = {}
        for part in sliced(batches, ROWS):
            for text, label, fold in zip(*(part.column(c).to_pylist() for c in ("text", "label", "fold")), strict=True):
                model = models[fold]
                found, size = model.found(text)
                if of == "tail":
                    tail = [s - TAIL for _, _, s in found if s >= TAIL]
                    key, add = label, (float(len(tail)), float(sum(tail)), float(size))
                else:
                    key, add = _bin(model.statistic(found, size)), (float(label), 1.0, 0.0)
                sums[key] = [a + b for a, b in zip(sums.get(key, (0.0, 0.0, 0.0)), add, strict=True)]
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array([sums[k][i] for k in keys], pa.float64()) for i in range(3))], names=["k", "a", "b", "c"])

    # at most two rows of the tail, or one for each bin
    return sample.mapInArrow(run, "k long, a double, b double, c double").groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c")).orderBy("k").collect()


def _curve(bins: list) -> tuple[float, float]:
    """Intercept and slope of a logistic curve over bins of ln(1 + statistic), by Newton's method with a weak pull to zero."""
    x = np.array([(r.k + 0.5) / 24 for r in bins])
    y, n = np.array([r.a for r in bins]), np.array([r.b for r in bins])
    if not len(x) or not 0 < y.sum() < n.sum():
        mean = (y.sum() + 0.5) / (n.sum() + 1) if len(x) else 0.5
        return float(np.log(mean / (1 - mean))), 0.0
    design, w = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (y - n * p) - 1e-2 * w
        hessian = design.T @ (design * (n * p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(0.0, w[1]))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn from labelled rows that are not held out: at most ``sample_docs`` of ``labels``, least hash of the id first.

    Without rows of both labels the model gives the mean label everywhere.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = _sample(docs, labels, label, sample_docs, scratch)
    counts = _counts(sample)
    model, crossed = Model(_of(counts.sum(axis=0))), [Model(_of(counts[1])), Model(_of(counts[0]))]
    tail = {r.k: r for r in _fitted(sample, crossed, "tail")}
    if 0 in tail and tail[0].c:
        n, excess, size = tail[0].a + 1.0, tail[0].b + 1.0, tail[0].c  # one segment of excess 1 as a prior
        for m in (model, *crossed):
            m.rate = min(5.0, n / excess)
            m.k = n * math.exp(m.rate * TAIL) / size
    model.intercept, model.slope = _curve(_fitted(sample, crossed, "bins"))
    scratch.drop(sample)
    return model


def scored(docs: DataFrame, model: Model, passages: bool = False) -> DataFrame:
    """The rows of ``docs`` with ``score``; with ``passages`` also (start, stop, score, expected) of the significant ones.

    A passage is significant if fewer than ``SIGNIFICANT`` like it are expected
    by chance; places are code points. Null and empty texts have no segment and
    get the curve's lowest value. Repeated rows and null ids stay; columns of
    these names are replaced; an empty table gives no rows.
    """
    names = ["score", "passages"] if passages else ["score"]
    docs = docs.drop(*names)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, ROWS):
            values, places = [], []
            for i in range(part.num_rows):
                text = part.column(at)[i].as_py() or ""
                found, size = model.found(text)
                values.append(model.probability(model.statistic(found, size)))
                if passages:
                    places.append([dict(zip(("start", "stop", "score", "expected"), x, strict=True)) for x in model.significant(text, found, size)])
            part = part.append_column("score", pa.array(values, pa.float64()))
            yield part.append_column("passages", pa.array(places, _PASSAGES)) if passages else part

    schema = StructType([*docs.schema.fields, StructField("score", DoubleType()), *([StructField("passages", ArrayType(_PASSAGE))] if passages else [])])
    return docs.mapInArrow(run, schema)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = scored(docs.select(F.col("doc_id").cast("long"), "text"), train(docs, labels), passages=True)
    return found.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), F.size("passages").alias("n_passages"))
