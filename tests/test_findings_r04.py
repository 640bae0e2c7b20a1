"""What the findings of the fourth round were about."""

import datetime

import duckdb

from ledgerloom.operators import verify as checks
from ledgerloom.plans import table_queries


def _tables(spark, folder) -> str:
    """Orders of five checkpoints with gaps, a ledger twice, keys that are null or below zero, and line items of no order."""
    day = datetime.datetime(2026, 1, 1)
    keys = [-3, 0, None, 70, 130, 130, *(k for k in range(1, 320) if k not in (65, 127, 128, 200, 319))]
    orders = [(k, 7 * i % 50 if k != 70 else i % 3, "OFP"[i % 3], 1.5, day, None if i % 11 == 0 else f"{i % 5}-x") for i, k in enumerate(keys)]
    items = [(k, 100 - i, i % 9 if i % 13 else None, n, None if i % 17 == 0 else "ANR"[n % 3], "OF"[i % 2]) for i, k in enumerate([None, -3, 999, *range(0, 320, 2), *range(0, 320, 5)]) for n in (3, 10, 2)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_all_checks_shuffle_lineitem_once_and_keep_a_row_for_each_checkpoint(spark, tmp_path, monkeypatch):
    """headers with four hashes each were shuffled and kept, and lineitem was shuffled three times."""
    d = _tables(spark, tmp_path)
    seen, cut = [], table_queries.cut

    def spy(df):
        seen.append((df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"), (out := cut(df)).count()))
        return out

    monkeypatch.setattr(table_queries, "cut", spy)
    rows = table_queries.failure_checkpoints(spark, d)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert seen == [(1, 5)] and "lineitem" not in plan and "l_orderkey" not in plan


def test_all_checks_by_checkpoint_find_what_separate_checks_find(spark, tmp_path, monkeypatch):
    d = _tables(spark, tmp_path)
    monkeypatch.setattr(table_queries, "_SORTED_ROWS", 60)  # so that parts are by rows
    headers, tx_sets, results, status = table_queries._ledgers(spark, d)
    want = {tuple(x) for x in checks.all_errors(status, headers, tx_sets, results).collect()}
    got = [tuple(x) for x in table_queries.all_checks(spark, d).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {x for x, _ in got} == {"ledger", "checkpoint", "boundary"}
    db = duckdb.connect()
    for t in ("orders", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    assert {x for x in got if x[1] > 0} == {x for x in db.execute(table_queries.ORACLE_SQL["all_checks"]).fetchall() if x[1] > 0}


def test_errors_by_checkpoint_follow_what_was_parsed(spark):
    """Files that were not read, ledgers outside their checkpoint, checkpoints without headers or without a status."""
    rows = [(63, s, f"h{s}", f"h{s - 1}", f"t{s}", "r", f"t{s}" if s != 9 else "bad", "r" if s != 5 else "bad") for s in range(1, 64)]
    rows += [(127, s, f"h{s}", f"h{s - 1}" if s != 64 else "x", f"t{s}", "r", "bad" if s == 70 else None, "r") for s in (64, 65, 70, 500)]
    rows += [(255, 200, "h", "p", "t", "r", "t", "bad")]
    ledgers = spark.createDataFrame(rows, "cp long, seq long, hash string, prev_hash string, tx_set_hash string, result_hash string, tx string, result string")
    status = [(63, "ledger", True), (63, "transactions", False), (63, "results", True), (127, "ledger", True), (127, "transactions", True), (191, "ledger", True), (319, "results", True), (383, "ledger", False), (447, "ledger", None), (447, "transactions", True)]
    status = spark.createDataFrame(status, "cp long, kind string, parsed boolean")
    other = lambda name: ledgers.where(f"{name} IS NOT NULL").select("cp", "seq", ledgers[name].alias("hash"))
    want = {tuple(x) for x in checks.all_errors(status, ledgers.drop("tx", "result"), other("tx"), other("result")).collect()}
    got = [tuple(x) for x in checks.errors_by_checkpoint(status, checks.by_checkpoint(ledgers)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {("checkpoint", 319), ("checkpoint", 191), ("boundary", 127), ("ledger", 5), ("ledger", 70)} <= want
