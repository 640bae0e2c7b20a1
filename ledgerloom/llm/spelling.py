"""Grouping of spelling variants by blocked Gram matrices of letter counts.

Words are counted over all documents. A word's block is its number of letters in
each of four groups of letters, and so its length. One edit changes its counts
by one in one group, or by one in two groups: two words that are one edit apart
lie in the same block or in adjacent ones, of the same or the next length. Large
blocks are split in tiles by hash. For each pair of tiles of adjacent blocks a
NumPy product of their letter counts gives all squared distances at once; pairs
at two or less are kept, as one edit changes one count by one, or two, and are
then compared letter by letter.

A product costs the product of two tiles' sizes: within a block the work grows
with the square of its words, which is of the method; blocks keep it far below
all pairs. Only tiles move; pairs leave a task once they are verified.
"""

from __future__ import annotations

import contextlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, cleaned_shuffles, sliced, sql_crc32

LEAST_LETTERS, LEAST_COUNT, SLIP, MUCH_MORE = 6, 5, 199, 5
GROUPS = 4
ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(map(chr, range(0xC0, 0x100)))
#: Letters of a tile (2,048 words of up to 16 letters), and rows of a product computed at once.
TILE, STRIPE = 1 << 15, 512
#: Characters of a text cut into runs at once, words held before they are sent on, rows taken from a batch at once.
STEP, HELD, ROWS = 1 << 20, 200_000, 256
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_COLUMN = np.full(0x100, -1, np.int64)
for _i, _c in enumerate(ALPHABET):
    _COLUMN[ord(_c)] = _i


def pieces(text: str) -> Iterator[str]:
    """The text in pieces of about ``STEP`` characters that part no run."""
    at = 0
    while at < len(text):
        stop = at + STEP
        if stop < len(text) and (m := _RUN.match(text, stop)):
            stop = m.end()
        yield text[at:stop]
        at = stop


def typed(run: str, seed: int | None) -> str:
    """What stands for a lower-cased run: itself, or with one letter less where its hash says so. ``seed`` is the crc32 of "<doc_id>:"."""
    if seed is None:
        return run
    h = zlib.crc32(run.encode(), seed)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def counted(docs: DataFrame) -> DataFrame:
    """(word, n) of all documents. Runs of a document without an id lose no letter."""

    def sent(held: Counter) -> pa.RecordBatch:
        words = [w for w in held if len(w) >= LEAST_LETTERS]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for part in sliced(batches, ROWS):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                seed = None if doc_id is None else zlib.crc32(f"{doc_id}:".encode())
                for piece in pieces(text.as_py() or ""):
                    # bytes.lower changes A-Z only
                    for word, n in Counter(_RUN.findall(piece.encode().lower().decode())).items():
                        if len(word) >= LEAST_LETTERS:
                            held[typed(word, seed)] += n
                    if len(held) > HELD:
                        yield sent(held)
                        held = Counter()
        yield sent(held)

    found = docs.select("doc_id", "text").where("text IS NOT NULL").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _group(letter: str) -> int:
    return ord(letter) % GROUPS


def block(word: Column) -> Column:
    """Letters of each group."""
    of = ["".join(c for c in ALPHABET if _group(c) == g) for g in range(GROUPS)]
    return F.array(*(F.length(word) - F.length(F.translate(word, letters, "")) for letters in of))


def neighbours() -> list[list[int]]:
    """Changes of a block by one edit, of each pair of opposite ones the one that ends higher; the first changes nothing."""
    unit = np.eye(GROUPS, dtype=int)
    replaced = [(unit[a] - unit[b]).tolist() for a in range(GROUPS) for b in range(GROUPS) if a < b]
    return [[0] * GROUPS, *unit.tolist(), *replaced]


def counts(codes: np.ndarray) -> np.ndarray:
    """Letter counts of words of equal length, given as code points (words x letters)."""
    n, letters = codes.shape
    at = np.repeat(np.arange(n), letters) * len(ALPHABET) + _COLUMN[codes.ravel()]
    kind = np.float32 if letters <= 2000 else np.float64  # sums of squares stay exact
    return np.bincount(at, minlength=n * len(ALPHABET)).reshape(n, len(ALPHABET)).astype(kind)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of ``a`` and ``b`` (code points; ``b`` as long, or longer by one) differ by exactly one edit."""
    letters = a.shape[1]
    head = np.logical_and.accumulate(a == b[:, :letters], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate(a[:, ::-1] == b[:, ::-1][:, :letters], axis=1).sum(axis=1)
    return (head + tail >= letters) if b.shape[1] > letters else (head + tail == letters - 1)


def near_pairs(a: list[str], b: list[str], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of the words one edit apart; of equal lists, each pair once."""
    codes = [np.array([list(map(ord, w)) for w in words], np.int64) for words in (a, b)]
    turned = codes[0].shape[1] > codes[1].shape[1]
    x, y = codes[::-1] if turned else codes
    left, right = counts(x), counts(y)
    square = (right**2).sum(axis=1)
    found = []
    for at in range(0, len(x), STRIPE):
        some = left[at : at + STRIPE]
        distance = (some**2).sum(axis=1)[:, None] + square - 2 * (some @ right.T)
        i, j = np.nonzero(distance <= 2)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        right_ones = one_edit(x[i], y[j])
        found.append((i[right_ones], j[right_ones]))
    i, j = (np.concatenate(z) for z in zip(*found, strict=True))
    return (j, i) if turned else (i, j)


@contextlib.contextmanager
def _small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """A row of two tiles may have 100 KB: batches of a few."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def near(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, near, near_n) of ``words(word, n)``, in both directions."""
    spark = words.sparkSession
    keyed = words.withColumn("block", block(F.col("word")))
    blocks = scratch.keep(keyed.groupBy("block").agg(F.ceil(F.count("*") * F.greatest(F.max(F.length("word")), F.lit(16)) / TILE).alias("tiles")))
    tile = F.pmod(F.xxhash64("word"), F.col("tiles")).alias("tile")
    tiles = scratch.keep(keyed.join(blocks, "block").select("block", tile, "word", "n").groupBy("block", "tile").agg(F.collect_list(F.struct("word", "n")).alias("words")))
    moves = F.explode(F.array(*(F.array(*map(F.lit, m)) for m in neighbours()))).alias("move")
    ahead = blocks.select(F.col("block").alias("a"), F.col("tiles").alias("a_tiles"), moves).withColumn("b", F.zip_with("a", "move", lambda x, y: x + y))
    both = ahead.join(blocks.select(F.col("block").alias("b"), F.col("tiles").alias("b_tiles")), "b")
    same = F.col("a") == F.col("b")
    pairs = both.select("a", "b", "b_tiles", F.explode(F.sequence(F.lit(0), F.col("a_tiles") - 1)).alias("a_tile"))
    pairs = pairs.select("a", "b", "a_tile", F.explode(F.sequence(F.when(same, F.col("a_tile")).otherwise(0), F.col("b_tiles") - 1)).alias("b_tile"))
    side = lambda s: tiles.select(F.col("block").alias(s), F.col("tile").alias(f"{s}_tile"), F.col("words").alias(f"{s}_words"))
    met = pairs.join(side("a"), ["a", "a_tile"]).join(side("b"), ["b", "b_tile"])
    met = met.select("a_words", "b_words", (same & (F.col("a_tile") == F.col("b_tile"))).alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (a, an), (b, bn) = ((s.field("word").to_pylist(), s.field("n").to_numpy()) for s in (batch.column(c)[k].values for c in ("a_words", "b_words")))
                i, j = near_pairs(a, b, batch.column("same")[k].as_py())
                left, right = pa.array(a, pa.string()).take(pa.array(i)), pa.array(b, pa.string()).take(pa.array(j))
                for x, y, n in ((left, right, bn[j]), (right, left, an[i])):
                    yield pa.RecordBatch.from_arrays([x, y, pa.array(n, pa.int64())], names=["word", "near", "near_n"])

    with _small_batches(spark, 16), cleaned_shuffles(spark):
        return scratch.keep(met.mapInArrow(run, "word string, near string, near_n long"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of ``forms(word, form)``: forms followed to the last, by doubling steps. A form has five times its word's count, so chains are short."""
    at = scratch.keep(forms.select("word", F.col("form").alias("root")))
    while True:
        further = at.join(at.select(F.col("word").alias("root"), F.col("root").alias("last")), "root", "left")
        after = scratch.keep(further.select("word", F.coalesce("last", "root").alias("root"), F.col("last").isNotNull().alias("moved")))
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        at = after.drop("moved")


def grouped(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words(word, n)``."""
    best = near(words, scratch).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    much = -F.col("best.less") >= MUCH_MORE * F.col("n")
    told = words.join(best, "word", "left").select(
        "word", F.when(much, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(much, -F.col("best.less")).alias("form_n")
    )
    told = scratch.keep(told)
    last = roots(told.where("form IS NOT NULL").select("word", "form"), scratch)
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    """Words of ``docs(doc_id, text)`` with the more frequent word that each is a variant of.

    A null text has no word; a null id changes no run; rows that repeat count
    each time. Texts of any length are cut between runs. Other columns are
    ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    return grouped(scratch.keep(counted(docs.select(F.col("doc_id").cast("long"), "text"))), scratch)


def query(docs: DataFrame) -> DataFrame:
    return variants(docs)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SQL_BYTES = "[CAST('0x' || substr(hex(encode(doc_id || ':' || run)), 2 * i + 1, 2) AS BIGINT) for i in range(octet_length(encode(doc_id || ':' || run)))]"
ORACLE_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents WHERE text IS NOT NULL
), distinct_runs AS (
  SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {LEAST_LETTERS} GROUP BY ALL
), hashed AS (
  SELECT run, n, CASE WHEN doc_id IS NOT NULL THEN {sql_crc32(_SQL_BYTES)} END AS h FROM distinct_runs
), typed AS (
  SELECT CASE WHEN h % {SLIP} = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM typed WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}
), cut AS (
  SELECT word, n, unnest(range(length(word))) AS i FROM words
), less AS (
  SELECT DISTINCT word, n, left(word, i) || substr(word, i + 2) AS rest FROM cut
), masked AS (
  SELECT word, n, left(word, i) || chr(1) || substr(word, i + 2) AS rest FROM cut
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT a.word, b.word, b.n FROM masked a JOIN masked b ON a.rest = b.rest AND a.word <> b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word
), told AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= {MUCH_MORE} * w.n THEN b.near END AS form, CASE WHEN b.near_n >= {MUCH_MORE} * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)
), chain AS (
  SELECT word, word AS at, form FROM told
  UNION ALL
  SELECT c.word, t.word, t.form FROM chain c JOIN told t ON c.form = t.word
)
SELECT told.word, told.form, chain.at AS root, n, n_near, form_n FROM told JOIN chain ON chain.word = told.word AND chain.form IS NULL
"""
