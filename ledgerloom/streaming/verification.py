"""Verifying an archive as it grows: hashes and the chain, across files that come in any order and in different batches.

The stream reads the names of new files; tasks decode them in ranges, as a scan
does. Rows of a checkpoint's files meet in state keyed by checkpoint, along with
the hash that the checkpoint before ends on, which that one's ledger file sends
there. Whenever something new came, the checkpoint's rows go on to the very
checks of a batch scan, and a table gets what they find; the last word on each
checkpoint is that of its last batch. State of a checkpoint ends when all its
files and the hash before it were seen, so state holds open checkpoints only,
however long the archive is. When files came that are later than a checkpoint's
last one by ``patience``, what it misses is told as overdue, once; it stays open. Times are of arrival, so that no
file is late for being old.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ledgerloom.functions.checkpoints import FREQUENCY, checkpoint_from_path, kind_of_path
from ledgerloom.operators import verify as checks
from ledgerloom.plans.shipping import ship
from ledgerloom.sources.decode import ROW_DDL, decoded
from ledgerloom.sources.storage import Archive

BINARY = "path string, modificationTime timestamp, length bigint, content binary"
KINDS = ("ledger", "transactions", "results")
BEFORE = "before"
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
CHECKPOINT = f"cp bigint, seen int, overdue boolean, missing array<string>, before_hash string, ledger_parsed boolean, transactions_parsed boolean, results_parsed boolean, ledger {ROW_DDL}, transactions {ROW_DDL}, results {ROW_DDL}"
VERDICT = "cp bigint, overdue boolean, missing array<string>, errors array<struct<error: string, id: bigint>>"
_FIELDS = ("seq", "hash", "prev_hash", "tx_set_hash", "result_hash")


def new_files(spark: SparkSession, archive: Archive) -> DataFrame:
    """Streaming (path, kind, cp) of ledger, transaction and result files as they appear; their names only are read here."""
    root = f"file://{archive.root}" if archive.scheme == "file" else archive.root
    files = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("pathGlobFilter", "{ledger,transactions,results}-*.xdr.gz").load(root)
    found = files.select(F.regexp_extract("path", r"((?:ledger|transactions|results)(?:/[0-9a-f]{2}){3}/[^/]+)$", 1).alias("path"))
    return found.select("path", kind_of_path(F.col("path")).alias("kind"), checkpoint_from_path(F.col("path")).alias("cp")).where("kind IS NOT NULL AND cp IS NOT NULL")


def messages(files: DataFrame, archive: Archive, skew: str) -> DataFrame:
    """(at, cp, kind, parsed, rows, hash): the rows of every file for its checkpoint, and for the next one the hash that this one ends on."""
    read = decoded(files, archive).select("cp", "kind", "parsed", "rows")
    last = F.element_at(F.array_sort("rows"), -1)["hash"]  # by seq, which comes first
    own = F.struct("cp", "kind", "parsed", "rows", F.lit(None).cast("string").alias("hash"))
    onward = F.struct((F.col("cp") + FREQUENCY).alias("cp"), F.lit(BEFORE).alias("kind"), F.lit(True).alias("parsed"), F.slice("rows", 1, 0).alias("rows"), last.alias("hash"))
    sends = (F.col("kind") == "ledger") & F.col("parsed") & (F.size("rows") > 0)
    out = read.select(F.explode(F.when(sends, F.array(own, onward)).otherwise(F.array(own))).alias("m")).select("m.*")
    # one time for each batch; the clock of a restart may lie behind by the skew
    return out.withColumn("at", F.current_timestamp()).withWatermark("at", skew)


class Open(StatefulProcessor):
    """The files of a checkpoint that came so far, as one JSON value."""

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "body string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, at = json.loads(self.held.get()[0]) if self.held.exists() else {}, 0
        for r in rows:
            at = max(at, int(r.at.timestamp() * 1000))
            if r.kind == BEFORE:
                held[BEFORE] = r.hash
            else:
                held[r.kind] = {"parsed": r.parsed, "rows": [[x[f] for f in _FIELDS] for x in r.rows or []]}
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if self._whole(key[0], held):
            self.held.clear()
        else:
            self.held.update((json.dumps(held),))
            self.handle.registerTimer(at + self.patience_ms)
        yield self._row(key[0], held, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.held.exists():
            yield self._row(key[0], json.loads(self.held.get()[0]), True)

    @staticmethod
    def _whole(cp: int, held: dict) -> bool:
        return all(k in held for k in KINDS) and (BEFORE in held or cp < FREQUENCY)

    @staticmethod
    def _row(cp: int, held: dict, overdue: bool) -> Row:
        parsed = [held[k]["parsed"] if k in held else None for k in KINDS]
        rows = [[Row(**dict(zip(_FIELDS, x, strict=True))) for x in held[k]["rows"]] if k in held else None for k in KINDS]
        names = ("cp", "seen", "overdue", "missing", "before_hash", *(f"{k}_parsed" for k in KINDS), *KINDS)
        values = (cp, len(held), overdue, [k for k in KINDS if k not in held], held.get(BEFORE), *parsed, *rows)
        return Row(*names)(*values)

    def close(self) -> None:
        pass


def open_checkpoints(stream: DataFrame, patience_ms: int) -> DataFrame:
    """What is known of each checkpoint that something new came for, or that is overdue."""
    return stream.groupBy("cp").transformWithState(Open(patience_ms), CHECKPOINT, "Update", "EventTime")


def verdicts(seen: DataFrame) -> DataFrame:
    """(cp, overdue, missing, errors) of one batch's checkpoints, by the checks of a batch scan. One without any file has not begun."""
    seen = seen.where(F.size("missing") < len(KINDS))
    status = seen.select("cp", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"{k}_parsed").alias("parsed")) for k in KINDS))).alias("s")).select("cp", "s.kind", "s.parsed").where("parsed IS NOT NULL")
    of = lambda kind, *columns: seen.where(f"{kind}_parsed").select("cp", F.explode(kind).alias("r")).select("cp", *(f"r.{c}" for c in columns))
    headers = of("ledger", "seq", "hash", "prev_hash", "tx_set_hash", "result_hash")
    inside = checks.file_errors(status, headers, of("transactions", "seq", "hash"), of("results", "seq", "hash")).union(checks.chain_failures(headers)).distinct()
    cp_of = F.when(F.col("error") == "ledger", F.ceil((F.col("id") + 1) / FREQUENCY) * FREQUENCY - 1).otherwise(F.col("id"))
    ends = checks.boundaries(headers).join(seen.where("before_hash IS NOT NULL").select("cp", "before_hash"), "cp")
    across = ends.where("first_prev_hash != before_hash").select("cp", F.lit("boundary").alias("error"), F.col("cp").alias("id"))
    errors = inside.select(cp_of.alias("cp"), "error", "id").union(across).groupBy("cp").agg(F.array_sort(F.collect_set(F.struct("error", "id"))).alias("errors"))
    none = F.from_json(F.lit("[]"), "array<struct<error: string, id: bigint>>")
    return seen.select("cp", "overdue", "missing").join(errors, "cp", "left").select("cp", "overdue", "missing", F.coalesce("errors", none).alias("errors"))


def follow_verified(spark: SparkSession, archive: Archive, table: str, checkpoint: str, patience_seconds: int = 3600, skew: str = "10 minutes", keep_on: bool = False) -> StreamingQuery:
    """Verify files as they appear; ends when all are read, or keeps on.

    Verdicts are appended to the Parquet table at ``table``; ``latest`` reads
    them. A batch that runs again after a failure writes its own folder anew.
    The state store is RocksDB, set for this query. Needs protobuf, as all
    arbitrary state in Python does.
    """
    ship(spark)

    def add(batch: DataFrame, number: int) -> None:
        # one row for each checkpoint: that with the most seen
        last = batch.groupBy("cp").agg(F.max_by(F.struct("*"), F.struct("seen", "overdue")).alias("m")).select("m.*")
        held = last.persist()
        try:
            verdicts(held).write.mode("overwrite").parquet(f"{table}/batch={number}")
        finally:
            held.unpersist()

    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        writer = open_checkpoints(messages(new_files(spark, archive), archive, skew), 1000 * patience_seconds).writeStream
        writer = writer.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime="10 seconds") if keep_on else writer.trigger(availableNow=True)).start()
    finally:
        if before is None:
            spark.conf.unset(STORE[0])
        else:
            spark.conf.set(STORE[0], before)


def latest(spark: SparkSession, table: str) -> DataFrame:
    """The last verdict on each checkpoint."""
    found = spark.read.schema(VERDICT + ", batch bigint").option("basePath", table).parquet(table)
    return found.groupBy("cp").agg(F.max_by(F.struct("overdue", "missing", "errors"), "batch").alias("v")).select("cp", "v.*")


def failed_checkpoints(spark: SparkSession, table: str) -> DataFrame:
    """(cp): checkpoints that a batch scan would mark as failed by their content."""
    errors = latest(spark, table).select(F.explode("errors").alias("e")).select("e.error", "e.id")
    return checks.failed_checkpoints(errors)
