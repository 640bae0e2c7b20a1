"""Archives as a Spark data source: ``spark.read.format("ledger_archive")``.

    spark.dataSource.register(ArchiveSource)
    spark.read.format("ledger_archive").option("kind", "ledger").option("high", 191).load("s3://box/archive")

A partition is a run of checkpoints. Its task reads each file in ranges, with
the decompressor's state carried from one to the next, and hands on rows as a
file ends. With the option ``pushdown``, filters on ``cp`` narrow the run before
any file is opened; ``spark.sql.python.filterPushdown.enabled`` must be on then.

Options: ``kind`` (ledger, transactions, results), ``low`` and ``high`` (ledgers,
rounded to checkpoints as by a scan; ``high`` is needed), ``perPartition``
(checkpoints), ``pushdown``, ``maxRetries``, ``rangeBytes``. A file that cannot be read, or
breaks a rule, is a row with its error and no sequence.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ledgerloom.functions.checkpoints import FIRST, FREQUENCY

from .decode import decode_file
from .storage import FATAL, Options, Store, StorageError, archive

HASHES = {"ledger": ("hash", "prev_hash", "tx_set_hash", "result_hash"), "transactions": ("hash",), "results": ("hash",)}


class Run(InputPartition):
    """Checkpoints from ``low`` to ``high``."""

    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class ArchiveReader(DataSourceReader):
    def __init__(self, store: Store, kind: str, low: int, high: int, per_partition: int):
        self.store, self.kind, self.low, self.high, self.per_partition = store, kind, low, high, per_partition

    def partitions(self) -> Sequence[InputPartition]:
        low = max(FIRST, -(-(self.low + 1) // FREQUENCY) * FREQUENCY - 1)
        step = FREQUENCY * self.per_partition
        found = [Run(at, min(at + step - FREQUENCY, self.high)) for at in range(low, self.high + 1, step)]
        return found or [Run(FREQUENCY, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for cp in range(partition.low, partition.high + 1, FREQUENCY):
            h = f"{cp:08x}"
            path = f"{self.kind}/{h[:2]}/{h[2:4]}/{h[4:6]}/{self.kind}-{h}.xdr.gz"
            try:
                rows, _ = decode_file(self.store, self.kind, cp, path)
            except StorageError as e:
                yield (cp, None, *[None] * len(HASHES[self.kind]), path, f"{e.kind}: {e}")
                continue
            for r in rows:
                yield (cp, r["seq"], *(r[c] for c in HASHES[self.kind]), path, None)


class FilteredReader(ArchiveReader):
    """A reader that filters on ``cp`` narrow; Spark refuses it unless its setting is on."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) == ("cp",) and isinstance(value, int):
                if isinstance(f, EqualTo | GreaterThanOrEqual | GreaterThan):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThanOrEqual | LessThan):
                    self.high = min(self.high, value - isinstance(f, LessThan))
            yield f  # Spark asks it of the rows again


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ledger_archive"

    def _kind(self) -> str:
        kind = self.options.get("kind", "ledger")
        if kind not in HASHES:
            raise StorageError(FATAL, f"kind {kind} is none of {', '.join(HASHES)}")
        return kind

    def schema(self) -> str:
        return "cp bigint, seq bigint, " + ", ".join(f"{c} string" for c in HASHES[self._kind()]) + ", path string, error string"

    def reader(self, schema) -> DataSourceReader:
        if "high" not in self.options:
            raise StorageError(FATAL, "name the last ledger by the option high")
        get = lambda k, other: int(self.options.get(k, other))
        options = Options(max_retries=get("maxRetries", 3), range_bytes=get("rangeBytes", 8 << 20))
        low = max(FIRST, (get("low", FIRST) + 1) // FREQUENCY * FREQUENCY - 1)
        high = get("high", 0) // FREQUENCY * FREQUENCY + FREQUENCY - 1
        kind = FilteredReader if self.options.get("pushdown", "").lower() == "true" else ArchiveReader
        return kind(archive(self.options["path"], options).store, self._kind(), low, high, max(1, get("perPartition", 64)))
