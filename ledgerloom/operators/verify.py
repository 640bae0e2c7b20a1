"""Checks over hash rows: completeness, agreement between files, and the hash chain.

Inputs: ``headers(cp, seq, hash, prev_hash, tx_set_hash, result_hash)``,
``tx_sets(cp, seq, hash)``, ``results(cp, seq, hash)`` and
``status(cp, kind, parsed)``, which tells a file without rows from one that was
not parsed. Outputs are failures ``(error, id)``: error is ledger, checkpoint or
boundary, id the sequence or checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.checkpoints import EMPTY_ARRAY_HASH, FREQUENCY, ceil_checkpoint, first_ledger, is_empty_tx_set_hash, is_zero_hash


def _failures(df: DataFrame, error: str, of: str) -> DataFrame:
    return df.select(F.lit(error).alias("error"), F.col(of).cast("bigint").alias("id"))


def expected_ledgers(checkpoints: DataFrame) -> DataFrame:
    """(cp, seq): all ledgers of ``checkpoints(cp)``."""
    return checkpoints.select("cp", F.explode(F.sequence(first_ledger(F.col("cp")), F.col("cp"))).alias("seq"))


def missing_ledgers(checkpoints: DataFrame, headers: DataFrame) -> DataFrame:
    return expected_ledgers(checkpoints).join(headers.select("cp", "seq"), ["cp", "seq"], "left_anti")


def unexpected_ledgers(headers: DataFrame) -> DataFrame:
    """Header rows outside their checkpoint's range."""
    return headers.where(~F.col("seq").between(first_ledger(F.col("cp")), F.col("cp"))).select("cp", "seq")


def incomplete(status: DataFrame, headers: DataFrame) -> DataFrame:
    """Checkpoints that lack ledgers, or whose ledger file was not parsed while another was."""
    parsed = status.where("parsed").groupBy("cp").agg(F.bool_or(F.col("kind") == "ledger").alias("has_ledger"), F.bool_or(F.col("kind").isin("transactions", "results")).alias("has_other"))
    unread = parsed.where("NOT has_ledger AND has_other").select("cp")
    missing = missing_ledgers(parsed.where("has_ledger").select("cp"), headers).select("cp")
    return _failures(unread.union(missing).union(unexpected_ledgers(headers).select("cp")).distinct(), "checkpoint", "cp")


def _compared(headers: DataFrame, other: DataFrame, status: DataFrame, kind: str) -> DataFrame:
    """Headers of checkpoints whose ``kind`` was parsed, with the other file's hash as ``found``."""
    read = status.where((F.col("kind") == kind) & F.col("parsed")).select("cp").distinct()
    found = other.select("cp", "seq", F.col("hash").alias("found"))
    return headers.join(read, "cp", "left_semi").join(found, ["cp", "seq"], "left")


def tx_set_mismatch(found: Column, expected: Column, result_hash: Column, prev_hash: Column) -> Column:
    """A set is missing rightly if the ledger has no results or the expected hash is an empty set's."""
    absent = (result_hash != EMPTY_ARRAY_HASH) & ~is_empty_tx_set_hash(expected, prev_hash)
    return F.when(found.isNull(), absent).otherwise(found != expected)


def result_mismatch(found: Column, expected: Column) -> Column:
    absent = (expected != EMPTY_ARRAY_HASH) & ~is_zero_hash(expected)
    return F.when(found.isNull(), absent).otherwise(found != expected)


def tx_set_failures(headers: DataFrame, tx_sets: DataFrame, status: DataFrame) -> DataFrame:
    both = _compared(headers, tx_sets, status, "transactions")
    return _failures(both.where(tx_set_mismatch(F.col("found"), F.col("tx_set_hash"), F.col("result_hash"), F.col("prev_hash"))), "ledger", "seq")


def result_failures(headers: DataFrame, results: DataFrame, status: DataFrame) -> DataFrame:
    both = _compared(headers, results, status, "results")
    return _failures(both.where(result_mismatch(F.col("found"), F.col("result_hash"))), "ledger", "seq")


def chain_failures(headers: DataFrame) -> DataFrame:
    """Inside a checkpoint: ledgers that do not follow their predecessor in sequence or hash. Groups are of 64 rows."""
    w = Window.partitionBy("cp").orderBy("seq")
    before = headers.select("seq", "prev_hash", F.lag("seq").over(w).alias("before"), F.lag("hash").over(w).alias("before_hash"))
    broken = (F.col("before") + 1 != F.col("seq")) | (F.col("before_hash") != F.col("prev_hash"))
    return _failures(before.where(F.col("before").isNotNull() & broken), "ledger", "seq")


def boundaries(headers: DataFrame) -> DataFrame:
    """(cp, first_prev_hash, last_hash)."""
    return headers.groupBy("cp").agg(F.min_by("prev_hash", "seq").alias("first_prev_hash"), F.max_by("hash", "seq").alias("last_hash"))


def boundary_failures(ends: DataFrame) -> DataFrame:
    """Across checkpoints that follow each other: an equi-join on the shifted key, no global order."""
    before = ends.select((F.col("cp") + FREQUENCY).alias("cp"), F.col("last_hash").alias("before_hash"))
    return _failures(ends.join(before, "cp").where("first_prev_hash != before_hash"), "boundary", "cp")


def failed_checkpoints(errors: DataFrame) -> DataFrame:
    """(cp): the checkpoints that errors mark; a boundary marks both its sides."""
    cp = F.col("id")
    marked = F.when(F.col("error") == "boundary", F.array(cp, cp - FREQUENCY)).when(F.col("error") == "ledger", F.array(ceil_checkpoint(cp))).otherwise(F.array(cp))
    return errors.select(F.explode(marked).alias("cp")).distinct()


def file_errors(status: DataFrame, headers: DataFrame, tx_sets: DataFrame, results: DataFrame) -> DataFrame:
    """Checks inside checkpoints and between their files; rows may repeat."""
    return incomplete(status, headers).union(tx_set_failures(headers, tx_sets, status)).union(result_failures(headers, results, status))


def chain_errors(headers: DataFrame) -> DataFrame:
    """Checks of the hash chain, inside checkpoints and across them; rows may repeat."""
    return chain_failures(headers).union(boundary_failures(boundaries(headers)))


def all_errors(status: DataFrame, headers: DataFrame, tx_sets: DataFrame, results: DataFrame) -> DataFrame:
    """Every check; duplicates are removed. Headers should be written or cached: they are read five times."""
    return file_errors(status, headers, tx_sets, results).union(chain_errors(headers)).distinct()


def by_checkpoint(ledgers: DataFrame) -> DataFrame:
    """(cp, tx, results, chain, complete, outside, first_prev_hash, last_hash): what the checks find in each checkpoint, in one pass.

    ``ledgers`` are headers with ``tx`` and ``result`` beside them, the hashes of
    the other files (null: none). No shuffle where rows are dealt by cp.
    """
    cp, seq = F.col("cp"), F.col("seq")
    w = Window.partitionBy("cp").orderBy("seq")
    follows = ledgers.withColumns({"before": F.lag("seq").over(w), "before_hash": F.lag("hash").over(w)})
    broken = F.col("before").isNotNull() & ((F.col("before") + 1 != seq) | (F.col("before_hash") != F.col("prev_hash")))
    inside = seq.between(first_ledger(cp), cp)
    found = lambda bad: F.collect_list(F.when(bad, seq))
    return follows.groupBy("cp").agg(
        found(tx_set_mismatch(F.col("tx"), F.col("tx_set_hash"), F.col("result_hash"), F.col("prev_hash"))).alias("tx"), found(result_mismatch(F.col("result"), F.col("result_hash"))).alias("results"), found(broken).alias("chain"),
        (F.size(F.collect_set(F.when(inside, seq))) == cp - first_ledger(cp) + 1).alias("complete"), F.bool_or(~inside).alias("outside"),
        F.min_by("prev_hash", "seq").alias("first_prev_hash"), F.max_by("hash", "seq").alias("last_hash"),
    )


def errors_by_checkpoint(status: DataFrame, checked: DataFrame) -> DataFrame:
    """The failures of :func:`all_errors` from what :func:`by_checkpoint` found. That is read three times, and has a row for each checkpoint."""
    read = lambda *kinds: F.bool_or(F.col("kind").isin(*kinds) & F.coalesce("parsed", F.lit(False)))
    files = status.groupBy("cp").agg(read("ledger").alias("ledger_read"), read("transactions").alias("tx_read"), read("results").alias("results_read"))
    both = checked.join(files, "cp", "full")
    none, has_ledger = F.array().cast("array<bigint>"), F.col("ledger_read")
    seqs = F.concat(*(F.when(on, F.col(name)).otherwise(none) for on, name in ((F.col("tx_read"), "tx"), (F.col("results_read"), "results"), (F.col("chain").isNotNull(), "chain"))))
    wrong = both.select(F.explode(seqs).alias("seq"))
    lacking = (has_ledger & F.col("cp").isNotNull() & ~F.coalesce("complete", F.lit(False))) | (~has_ledger & (F.col("tx_read") | F.col("results_read"))) | F.col("outside")
    errors = _failures(wrong, "ledger", "seq").union(_failures(both.where(lacking), "checkpoint", "cp"))
    return errors.union(boundary_failures(checked)).distinct()
