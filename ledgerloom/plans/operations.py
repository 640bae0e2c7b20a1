"""scan, mirror and repair.

Each is a few Spark jobs over the expected set of files. The driver reads the
root pointer, resolves the bounds, and acts on the outcome; everything per file
or per ledger is a DataFrame. Tables whose making has side effects, or which
later steps read more than once, are cut from their lineage.
"""

from __future__ import annotations

import glob
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.checkpoints import FREQUENCY, KIND_FLAGS, OPTIONAL_KIND, bucket_path, checkpoint_path
from ledgerloom.functions.states import bucket_hashes, state_error
from ledgerloom.operators import bounds as limits
from ledgerloom.operators import failures as failing
from ledgerloom.operators import report as reports
from ledgerloom.operators import verify as checks
from ledgerloom.sources import history
from ledgerloom.sources.decode import ROW_DDL, decoded, parsed_states, written
from ledgerloom.sources.storage import Archive, StorageError

from .phases import Phases, recorded, timed, watched, watched_files
from .scratch import cut
from .shipping import ship

WELL_KNOWN = ".well-known"
POINTER_VARIABLE = "LEDGERLOOM_ROOT_POINTER"
FILE_KINDS = [k for k in KIND_FLAGS if k != "history"]
OUTCOME = "path string, kind string, cp bigint, outcome string, error_class string, error string"


class OperationFailed(Exception):
    def __init__(self, message: str, result: Result | None = None):
        super().__init__(message)
        self.result = result


@dataclass
class Result:
    """What one pass did: a row per file, the failures, and the checkpoint of a broken root pointer."""

    outcomes: DataFrame
    failures: DataFrame
    well_known: int | None = None
    errors: DataFrame | None = None
    report: dict = field(default_factory=dict)
    phases: Phases | None = None

    @property
    def failed(self) -> bool:
        return self.well_known is not None or not self.failures.isEmpty()

    def section(self) -> dict:
        return reports.section(self.failures, self.outcomes, self.well_known)


# --- the root pointer, on the driver -----------------------------------------


def pointer_path(archive: Archive, given: str | None = None) -> str:
    """The root pointer's path: as given, from the environment, or the one file of its folder."""
    given = given or os.environ.get(POINTER_VARIABLE)
    if given:
        return given if "/" in given else f"{WELL_KNOWN}/{given}"
    if archive.scheme == "file":
        found = sorted(glob.glob(f"{glob.escape(archive.root)}/{WELL_KNOWN}/*.json"))
        if found:
            return f"{WELL_KNOWN}/{os.path.basename(found[0])}"
        raise StorageError("not_found", f"no root pointer in {archive.root}/{WELL_KNOWN}")
    raise StorageError("fatal", f"name the root pointer of {archive.root} by root_pointer or {POINTER_VARIABLE}")


def read_pointer(spark: SparkSession, archive: Archive, path: str, retries: bool = True) -> int:
    """The checkpoint that the root pointer names; raises ``StorageError`` if it is missing or breaks a rule."""
    content = archive.read(path, retries)
    one = parsed_states(spark.createDataFrame([(path, None, content, None, None)], "path string, cp bigint, content binary, error_class string, error string"))
    row = one.select(F.coalesce("error", state_error(F.col("state"))).alias("error"), F.col("state.currentLedger").alias("ledger")).first()
    if row.error is not None:
        raise StorageError("fatal", f"{path}: {row.error}")
    return limits.floor_checkpoint(row.ledger)


# --- expected files ----------------------------------------------------------


def checkpoints_of(spark: SparkSession, b: limits.Bounds) -> DataFrame:
    return spark.range(b.low, b.high + 1 if not b.empty else b.low, FREQUENCY).select(F.col("id").alias("cp"))


def history_files(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.select("cp", F.lit("history").alias("kind"), checkpoint_path(F.lit("history"), F.col("cp")).alias("path"))


def checkpoint_files(checkpoints: DataFrame, skip_optional: bool) -> DataFrame:
    kinds = [k for k in FILE_KINDS if not (skip_optional and k == OPTIONAL_KIND)]
    exploded = checkpoints.select("cp", F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    return exploded.select("cp", "kind", checkpoint_path(F.col("kind"), F.col("cp")).alias("path"))


def needed_buckets(states: DataFrame) -> DataFrame:
    """Buckets of ``states(cp, state)``, each once, whatever the case of its hash."""
    once = each_once(states.select("cp", F.explode(bucket_hashes(F.col("state"))).alias("hash")))
    return once.select("cp", F.lit("bucket").alias("kind"), bucket_path(F.col("hash")).alias("path"))


def each_once(refs: DataFrame) -> DataFrame:
    """(key, cp, hash, refs) of ``refs(cp, hash)``: every bucket once, with its first checkpoint and the number of references."""
    once = refs.groupBy(F.lower("hash").alias("key")).agg(F.min(F.struct("cp", "hash")).alias("first"), F.count("*").alias("refs"))
    return once.select("key", F.col("first.cp").alias("cp"), F.col("first.hash").alias("hash"), "refs")


def _states(archive: Archive, files: DataFrame) -> DataFrame:
    """(path, cp, state, content, error_class, error): parsed and validated history files."""
    parsed = parsed_states(archive.contents(files))
    read = F.col("content").isNotNull()
    parsed = watched(parsed, history_fetch=(read, F.length("content"), F.col("fetch_ns")), history_parse=(read, F.length("content"), F.col("parse_ns"))).drop("fetch_ns", "parse_ns")
    broken = state_error(F.col("state"))
    return parsed.withColumns({"error_class": F.coalesce("error_class", F.when(broken.isNotNull(), "fatal")), "error": F.coalesce("error", broken)})


def _outcome(df: DataFrame, ok: str = "processed") -> DataFrame:
    return df.select("path", "kind", "cp", F.when(F.col("error_class").isNull(), ok).otherwise("failed").alias("outcome"), "error_class", "error")


def _rows(read: DataFrame, kind: str, *columns: str) -> DataFrame:
    return read.where((F.col("kind") == kind) & F.col("parsed")).select("cp", F.explode("rows").alias("r")).select("cp", "r.seq", *(f"r.{c}" for c in columns))


def cross_checks(read: DataFrame) -> DataFrame:
    """Errors of ``read(kind, cp, parsed, rows)``."""
    status = read.where(F.col("kind").isin("ledger", "transactions", "results")).select("cp", "kind", "parsed")
    with timed("cross_file_verify"):
        headers = cut(_rows(read, "ledger", "hash", "prev_hash", "tx_set_hash", "result_hash").repartition("cp"))
        inside = cut(checks.file_errors(status, headers, _rows(read, "transactions", "hash"), _rows(read, "results", "hash")))
    with timed("chain_verify"):
        return cut(inside.union(checks.chain_errors(headers)).distinct())


def _result(outcomes: DataFrame, read: DataFrame | None) -> Result:
    failures = failing.of_paths(outcomes.where("outcome = 'failed'").select("path", "cp"))
    errors = None
    if read is not None:
        errors = cross_checks(read)
        failures = failures.union(failing.of_checkpoints(checks.failed_checkpoints(errors)))
    return Result(outcomes, cut(failures), errors=errors)


# --- operations --------------------------------------------------------------


class Operation:
    """What a pass over an archive's checkpoints does; scan, mirror and repair are of this kind, others may be.

    ``run`` asks for the bounds, then for the history files of all checkpoints,
    then for the files that these and their states call for. The answers are
    DataFrames with a row for each file, so an operation says what is done with a
    file and Spark where.
    """

    name = "operation"
    skip_optional = False

    def bounds(self, spark: SparkSession) -> limits.Bounds:
        """The checkpoints to go through."""
        raise NotImplementedError

    def histories(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(outcomes, states) of ``files(cp, kind, path)``: outcomes are ``OUTCOME`` rows, states(cp, state) those whose buckets are wanted."""
        raise NotImplementedError

    def objects(self, files: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """(outcomes, read) of ``files(cp, kind, path)``: read are the decoded rows to check across files, or None."""
        raise NotImplementedError

    def finalize(self, b: limits.Bounds, result: Result) -> None:
        """What is left to do once all files are through; raises ``OperationFailed`` to fail the run."""


def _pass(operation: Operation, checkpoints: DataFrame, with_history: bool = True) -> Result:
    files, outcomes = checkpoint_files(checkpoints, operation.skip_optional), None
    if with_history:
        outcomes, states = operation.histories(history_files(checkpoints))
        files = files.unionByName(needed_buckets(states))
    found, read = operation.objects(files)
    return _result(cut(found if outcomes is None else found.unionByName(outcomes)), read)


def run(spark: SparkSession, operation: Operation, report_path: str | None = None) -> Result:
    """One pass of an operation over its bounds, its report, and its end."""
    ship(spark)
    with recorded() as phases:
        b = operation.bounds(spark)
        result = _pass(operation, checkpoints_of(spark, b))
        result.phases = phases
        result.report = reports.single(result.section())
        if report_path:
            reports.write(report_path, result.report)
        operation.finalize(b, result)
    return result


def _need_success(name: str, result: Result) -> None:
    if result.failed:
        raise OperationFailed(f"{name} found failures", result)


# --- scan --------------------------------------------------------------------


@dataclass
class Scan(Operation):
    """That all files of an archive exist, or with ``verify`` that they hold."""

    archive: Archive
    low: int | None = None
    high: int | None = None
    verify: bool = False
    skip_optional: bool = False
    root_pointer: str | None = None
    name = "scan"

    def bounds(self, spark: SparkSession) -> limits.Bounds:
        return limits.archive_bounds(read_pointer(spark, self.archive, pointer_path(self.archive, self.root_pointer)), self.low, self.high)

    def histories(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        states = cut(_states(self.archive, files).drop("content").withColumn("kind", F.lit("history")))
        return _outcome(states), states.where("error_class IS NULL")

    def objects(self, files: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        if self.verify:
            read = cut(watched_files(decoded(files, self.archive), False))
            return _outcome(read), read
        there = self.archive.present(files)
        return there.select("path", "kind", "cp", F.when(F.col("present"), "processed").otherwise("failed").alias("outcome"), "error_class", "error"), None

    def finalize(self, b: limits.Bounds, result: Result) -> None:
        _need_success(self.name, result)


def scan(spark: SparkSession, archive: Archive, low: int | None = None, high: int | None = None, verify: bool = False, skip_optional: bool = False, report_path: str | None = None, root_pointer: str | None = None) -> Result:
    """Audit an archive. Raises ``OperationFailed`` on any failure."""
    return run(spark, Scan(archive, low, high, verify, skip_optional, root_pointer), report_path)


# --- mirror ------------------------------------------------------------------


def _fetch(source: Archive, target: Archive, files: DataFrame, verify: bool) -> DataFrame:
    """Fetch files and write each once it holds."""
    return cut(watched_files(decoded(files, source, target, verify), True))


def _fetch_states(source: Archive, target: Archive, files: DataFrame) -> DataFrame:
    """Fetch history files; each is written once it parses."""
    fetched = cut(_states(source, files).withColumn("kind", F.lit("history")))
    after = written(fetched, target).select("path", F.col("error_class").alias("w_class"), F.col("error").alias("w_error"))
    joined = fetched.drop("content").join(cut(after), "path", "left")
    return joined.withColumns({"error_class": F.coalesce("error_class", "w_class"), "error": F.coalesce("error", "w_error")}).drop("w_class", "w_error")


@dataclass
class Mirror(Operation):
    """Copy what the destination lacks, or everything with ``overwrite``; the destination's pointer only moves forward."""

    source: Archive
    target: Archive
    low: int | None = None
    high: int | None = None
    overwrite: bool = False
    allow_gaps: bool = False
    verify: bool = False
    skip_optional: bool = False
    root_pointer: str | None = None
    name = "mirror"
    existing = None

    def bounds(self, spark: SparkSession) -> limits.Bounds:
        _need_writable(self.target)
        pointer = pointer_path(self.source, self.root_pointer)
        latest = read_pointer(spark, self.source, pointer)
        try:
            self.existing = read_pointer(spark, self.target, pointer, retries=False)
        except StorageError:
            self.existing = None
        return limits.mirror_bounds(latest, self.existing, self.low, self.high, self.overwrite, self.allow_gaps)

    def histories(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        kept = None
        if not self.overwrite:
            kept = cut(_states(self.target, files).where("error_class IS NULL").drop("content").withColumn("kind", F.lit("history")))
            files = files.join(kept.select("path"), "path", "left_anti")
        fetched = _fetch_states(self.source, self.target, files)
        outcomes, states = _outcome(fetched), fetched.select("cp", "state", "error_class")
        if kept is not None:
            outcomes = outcomes.unionByName(_outcome(kept, "skipped"))
            states = states.unionByName(kept.select("cp", "state", "error_class"))
        return outcomes, cut(states).where("error_class IS NULL")

    def objects(self, files: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        skipped = None
        if not self.overwrite:
            there = cut(self.target.present(files))
            skipped = there.where("present").select("path", "kind", "cp", F.lit("skipped").alias("outcome"), "error_class", "error")
            files = there.where("NOT present").drop("present", "error_class", "error")
        read = _fetch(self.source, self.target, files, self.verify)
        outcomes = _outcome(read)
        return (outcomes if skipped is None else skipped.unionByName(outcomes)), (read if self.verify else None)

    def finalize(self, b: limits.Bounds, result: Result) -> None:
        _need_success(self.name, result)
        pointer = pointer_path(self.source, self.root_pointer)
        if not b.empty and (self.existing is None or b.high > self.existing) and not _restore_pointer(self.target, b.high, pointer):
            raise OperationFailed("mirror could not write the root pointer", result)


def _need_writable(target: Archive) -> None:
    if not target.writable:
        raise StorageError("fatal", f"{target.root} cannot be written")


def _restore_pointer(target: Archive, cp: int, pointer: str) -> bool:
    """Copy a checkpoint's history file of the destination to its root pointer."""
    name = f"{cp:08x}"
    try:
        target.write(pointer, target.read(f"history/{name[:2]}/{name[2:4]}/{name[4:6]}/history-{name}.json", retries=False))
    except StorageError:
        return False
    return True


def mirror(spark: SparkSession, source: Archive, target: Archive, low: int | None = None, high: int | None = None, overwrite: bool = False, allow_gaps: bool = False, verify: bool = False, skip_optional: bool = False, report_path: str | None = None, root_pointer: str | None = None) -> Result:
    """Copy an archive. The destination's pointer only moves forward, and only after a pass without failures."""
    return run(spark, Mirror(source, target, low, high, overwrite, allow_gaps, verify, skip_optional, root_pointer), report_path)


# --- repair ------------------------------------------------------------------


@dataclass
class Repair(Operation):
    """Keep what is good at the destination, fetch the rest; under ``dry_run`` only tell. Its bounds are known beforehand."""

    source: Archive
    target: Archive
    verify: bool = False
    skip_optional: bool = False
    dry_run: bool = False
    name = "repair"

    def histories(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        probed = cut(_states(self.target, files).drop("content").withColumn("kind", F.lit("history")))
        good = probed.where("error_class IS NULL")
        if self.dry_run:
            return _outcome(probed), good
        fetched = _fetch_states(self.source, self.target, probed.where("error_class IS NOT NULL").select("cp", "kind", "path"))
        states = cut(good.select("cp", "state", "error_class").unionByName(fetched.select("cp", "state", "error_class")))
        return _outcome(good).unionByName(_outcome(fetched)), states.where("error_class IS NULL")

    def objects(self, files: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        kept, broken, read = _probe(self.target, files, self.verify)
        found = kept.select("path", "kind", "cp", F.lit("processed").alias("outcome"), "error_class", "error")
        if self.dry_run:
            return found.unionByName(broken.select("path", "kind", "cp", F.lit("failed").alias("outcome"), F.lit("fatal").alias("error_class"), F.lit("needs repair").alias("error"))), read
        again = _fetch(self.source, self.target, broken.select("path", "kind", "cp"), self.verify)
        return found.unionByName(_outcome(again)), None if read is None else cut(read.unionByName(again))


def _probe(target: Archive, files: DataFrame, verify: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(kept, broken, read) of ``files`` at the destination."""
    if verify:
        probe = cut(watched_files(decoded(files, target), False))
        kept = probe.where("parsed")
        return kept, probe.where("NOT parsed"), kept
    there = cut(target.present(files))
    return there.where("present"), there.where("NOT present"), None


def _retry_files(source: Archive, target: Archive, failures: DataFrame, verify: bool) -> Result:
    """Fetch listed files again without looking at the destination; buckets found through a history file are probed first."""
    spark = failures.sparkSession
    work = cut(failing.work_list(failures))
    histories = _fetch_states(source, target, work.where("kind = 'history'").select("cp", "kind", "path"))
    listed = work.where("kind != 'history'").select("path", "kind", "cp")
    discovered = needed_buckets(histories.where("error_class IS NULL")).select("path", "kind", "cp").join(listed.select("path"), "path", "left_anti")
    kept, broken, _ = _probe(target, cut(discovered), verify)
    read = _fetch(source, target, listed.unionByName(broken.select("path", "kind", "cp")), verify)
    none = F.lit(None).cast("string")
    outcomes = _outcome(read).unionByName(_outcome(histories)).unionByName(kept.select("path", "kind", "cp", F.lit("processed").alias("outcome"), none.alias("error_class"), none.alias("error")))
    assert outcomes.sparkSession is spark
    return _result(cut(outcomes), None)


def _retry_checkpoints(source: Archive, target: Archive, failures: DataFrame, verify: bool, skip_optional: bool) -> Result:
    """Fetch whole checkpoints again and check them, and the chain among them, once more."""
    checkpoints = failures.where("kind = 'checkpoint'").select("cp").distinct()
    again = Mirror(source, target, overwrite=True, verify=verify, skip_optional=skip_optional)
    return _pass(again, cut(checkpoints), with_history=False)


def _retries(source: Archive, target: Archive, failures: DataFrame, well_known: int | None, pointer: str, verify: bool, skip_optional: bool) -> tuple[Result, Result]:
    files = _retry_files(source, target, failures, verify)
    whole = _retry_checkpoints(source, target, failures, verify, skip_optional)
    if well_known is not None and not _restore_pointer(target, well_known, pointer):
        files.well_known = well_known
    return files, whole


def repair(spark: SparkSession, source: Archive, target: Archive, low: int | None = None, high: int | None = None, verify: bool = False, dry_run: bool = False, plan: dict | str | None = None, skip_optional: bool = False, report_path: str | None = None, root_pointer: str | None = None) -> dict[str, Result]:
    """Mend an archive from a source, in stages: main pass, single files, whole checkpoints, root pointer.

    With ``dry_run`` nothing is written but the report, which is a plan. With
    ``plan`` the main pass is replaced by the plan's failures.
    """
    ship(spark)
    _need_writable(target)
    with recorded() as phases:
        return _repair(spark, source, target, low, high, verify, dry_run, plan, skip_optional, report_path, root_pointer, phases)


def _repair(spark: SparkSession, source: Archive, target: Archive, low: int | None, high: int | None, verify: bool, dry_run: bool, plan: dict | str | None, skip_optional: bool, report_path: str | None, root_pointer: str | None, phases: Phases) -> dict[str, Result]:
    if plan is not None:
        if low is not None or high is not None or dry_run:
            raise ValueError("a plan excludes low, high and dry_run")
        failures, well_known = reports.plan_failures(spark, plan)
        if well_known is None and failures.isEmpty():
            return {}
        # the pointer's name matters only where the pointer is restored
        pointer = pointer_path(source, root_pointer) if well_known is not None else ""
        files, whole = _retries(source, target, cut(failures), well_known, pointer, verify, skip_optional)
        return _finish_repair({"file_retry": files, "checkpoint_retry": whole}, report_path, phases)
    try:
        pointer = pointer_path(target, root_pointer)
        latest, broken_pointer = read_pointer(spark, target, pointer, retries=False), False
    except StorageError:
        pointer = pointer_path(source, root_pointer)
        latest, broken_pointer = read_pointer(spark, source, pointer), True
    b = limits.archive_bounds(latest, low, high)
    main = _pass(Repair(source, target, verify, skip_optional, dry_run), checkpoints_of(spark, b))
    main.well_known = b.high if broken_pointer else None
    if dry_run:
        main.phases = phases
        main.report = reports.single(main.section())
        if report_path:
            reports.write(report_path, main.report)
        return {"main_pass": main}
    files, whole = _retries(source, target, main.failures, main.well_known, pointer, verify, skip_optional)
    return _finish_repair({"main_pass": main, "file_retry": files, "checkpoint_retry": whole}, report_path, phases)


def _finish_repair(stages: dict[str, Result], report_path: str | None, phases: Phases) -> dict[str, Result]:
    for r in stages.values():
        r.phases = phases  # of all stages together
    if report_path:
        reports.write(report_path, reports.multi({name: r.section() for name, r in stages.items()}))
    if stages["file_retry"].failed or stages["checkpoint_retry"].failed:
        raise OperationFailed("repair left failures", stages["file_retry"])
    return stages


__all__ = ["Operation", "OperationFailed", "Result", "history", "mirror", "repair", "run", "scan", "ROW_DDL"]
