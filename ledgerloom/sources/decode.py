"""Decoding of archive files in tasks: paths in, status and hash rows out, and a copy on the way."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import history, xdr
from .storage import FATAL, RETRY, Archive, Pace, StorageError
from .stores import Store, with_retries

_HASHES = ("hash", "prev_hash", "tx_set_hash", "result_hash")
_ROW = pa.list_(pa.struct([("seq", pa.int64()), *((h, pa.string()) for h in _HASHES)]))
#: What is told of each file beside its rows: compressed and decompressed bytes, and nanoseconds.
SPENT = ("bytes_in", "bytes_out", "fetch_ns", "decompress_ns", "parse_ns", "write_ns")
ROW_DDL = "array<struct<seq: bigint, " + ", ".join(f"{h}: string" for h in _HASHES) + ">>"
_NEXT = pa.struct([("state", pa.int64()), ("output", pa.string()), ("curr", pa.string()), ("snap", pa.string()), ("shadow", pa.list_(pa.string()))])
_LEVELS = pa.list_(pa.struct([("curr", pa.string()), ("snap", pa.string()), ("next", _NEXT)]))
_STATE = pa.struct([("version", pa.int64()), ("server", pa.string()), ("currentLedger", pa.int64()), ("networkPassphrase", pa.string()), ("currentBuckets", _LEVELS), ("hotArchiveBuckets", _LEVELS)])


class _Clocked:
    """An iterator that keeps the time its items took, and their bytes."""

    def __init__(self, items: Iterator[bytes]):
        self.items, self.ns, self.size = items, 0, 0

    def __iter__(self) -> Iterator[bytes]:
        return self

    def __next__(self) -> bytes:
        began = time.perf_counter_ns()
        try:
            item = next(self.items)
        finally:
            self.ns += time.perf_counter_ns() - began
        self.size += len(item)
        return item


def _rows_of(kind: str, cp: int | None, path: str, content: Iterator[bytes], given: Iterator[bytes]) -> list[dict]:
    """Rows of one file from its content; what follows the content in ``given`` is read as well."""
    if kind == "bucket":
        xdr.check_sum(content, path.rsplit("bucket-", 1)[1].split(".")[0])
        found = []
    else:
        found = xdr.decode_pieces(kind, cp, content)
    for _ in given:
        pass
    return found


def decode_file(source: Store, kind: str, cp: int | None, path: str, target: Store | None = None, verify: bool = True, pace: Pace | None = None) -> tuple[list[dict], dict[str, int]]:
    """(rows, bytes and times) of one file, read in ranges, checked and copied as it comes; raises ``StorageError`` if it breaks a rule.

    The copy is committed once the whole file holds. Damage that may be of the
    transfer is fetched again.
    """
    spent = dict.fromkeys(SPENT, 0)

    def attempt() -> list[dict]:
        staged = None
        ranges = _Clocked(source.ranges(path, pace))

        def given() -> Iterator[bytes]:
            nonlocal staged
            for piece in ranges:
                if target is not None:
                    began = time.perf_counter_ns()
                    staged = staged or target.stage(path)
                    staged.write(piece)
                    spent["write_ns"] += time.perf_counter_ns() - began
                yield piece

        began, before = time.perf_counter_ns(), spent["write_ns"]
        some = given()
        try:
            rows: list[dict] = []
            if verify and kind != "history":
                content = _Clocked(xdr.pieces(some))
                rows = _rows_of(kind, cp, path, content, some)
                spent["bytes_out"] += content.size
                spent["decompress_ns"] += content.ns - ranges.ns - (spent["write_ns"] - before)
                spent["parse_ns"] += time.perf_counter_ns() - began - content.ns
            else:
                for _ in some:
                    pass
            if target is not None:
                begun = time.perf_counter_ns()
                (staged or target.stage(path)).commit()
                spent["write_ns"] += time.perf_counter_ns() - begun
        except BaseException:
            if staged is not None:
                staged.abort()
            raise
        finally:
            spent["bytes_in"] += ranges.size
            spent["fetch_ns"] += ranges.ns
        return rows

    try:
        return with_retries(attempt, source.options, lambda e: isinstance(e, xdr.Broken) and e.retry), spent
    except xdr.Broken as e:
        raise StorageError(RETRY if e.retry else FATAL, f"{path}: {e}") from e


def decoded(files: DataFrame, source: Archive, target: Archive | None = None, verify: bool = True) -> DataFrame:
    """(path, kind, cp, parsed, rows, error_class, error, bytes and times) of ``files(path, kind, cp)``, read by the tasks that own their rows.

    ``parsed`` tells an empty file from one that could not be read. With
    ``target`` the compressed bytes are written there and committed once they
    hold: nothing is seen that did not pass, and an older copy stays in place
    otherwise. A task holds a range of a file, never a file.
    """
    files, paced = source.paced(files.select("path", "kind", "cp"))
    origin, goal = source.store, None if target is None else target.store

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace = paced()
        for batch in batches:
            for path, kind, cp in zip(*(batch.column(n).to_pylist() for n in ("path", "kind", "cp")), strict=True):
                rows, spent, error_class, error = [], dict.fromkeys(SPENT, 0), None, None
                try:
                    rows, spent = decode_file(origin, kind, cp, path, goal, verify, pace)
                except StorageError as e:
                    error_class, error = e.kind, str(e)
                rows = [{"seq": r["seq"], **{h: r.get(h) for h in _HASHES}} for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([kind]), pa.array([cp], pa.int64()), pa.array([error_class is None]), pa.array([rows], _ROW), pa.array([error_class], pa.string()), pa.array([error], pa.string()), *(pa.array([spent[s]], pa.int64()) for s in SPENT)],
                    names=["path", "kind", "cp", "parsed", "rows", "error_class", "error", *SPENT],
                )

    more = ", ".join(f"{s} bigint" for s in SPENT)
    return files.mapInArrow(run, f"path string, kind string, cp bigint, parsed boolean, rows {ROW_DDL}, error_class string, error string, {more}")


def written(files: DataFrame, target: Archive) -> DataFrame:
    """(path, error_class, error) of ``files(path, content, error_class)``: values written whole or not at all; those with an error are left out."""
    goal = target.store

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                error_class = error = None
                try:
                    staged = goal.stage(path)
                    try:
                        staged.write(content.as_py())
                    except BaseException:
                        staged.abort()
                        raise
                    staged.commit()
                except StorageError as e:
                    error_class, error = e.kind, str(e)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([error_class], pa.string()), pa.array([error], pa.string())], names=["path", "error_class", "error"])

    return files.where("error_class IS NULL").select("path", "content").mapInArrow(run, "path string, error_class string, error string")


def parsed_states(files: DataFrame) -> DataFrame:
    """(path, cp, state, content, error_class, error) for history files with their content; rules over states come after."""
    from ledgerloom.functions.states import STATE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states, took, classes, errors = [], [], batch.column("error_class").to_pylist(), batch.column("error").to_pylist()
            for i, content in enumerate(batch.column("content").to_pylist()):
                state, began = None, time.perf_counter_ns()
                if classes[i] is None:
                    try:
                        state = history.parse(content)
                    except history.Malformed as e:
                        classes[i], errors[i] = FATAL, str(e)
                states.append(state)
                took.append(time.perf_counter_ns() - began)
            yield pa.RecordBatch.from_arrays(
                [batch.column("path"), batch.column("cp"), pa.array(states, _STATE), batch.column("content"), pa.array(classes, pa.string()), pa.array(errors, pa.string()), batch.column("fetch_ns"), pa.array(took, pa.int64())],
                names=["path", "cp", "state", "content", "error_class", "error", "fetch_ns", "parse_ns"],
            )

    fetch_ns = F.col("fetch_ns") if "fetch_ns" in files.columns else F.lit(0).cast("bigint").alias("fetch_ns")
    ddl = f"path string, cp bigint, state {STATE.simpleString()}, content binary, error_class string, error string, fetch_ns bigint, parse_ns bigint"
    return files.select("path", "cp", "content", "error_class", "error", fetch_ns).mapInArrow(run, ddl)
