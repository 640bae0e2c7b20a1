"""Calls, bytes and time of an operation's phases, by ``observe()`` on the tables that tasks make.

Times are sums over tasks and may overlap; those of the two checks are of the
driver's clock. Only tasks that succeed count.
"""

from __future__ import annotations

import contextlib
import time
from collections.abc import Iterator
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# The phases, in their order.
PHASES = ("history_fetch", "history_parse", "bucket_stream", "xdr_decompress", "xdr_parse_ledger", "xdr_parse_tx", "xdr_parse_result", "xdr_parse_scp", "cross_file_verify", "chain_verify", "copy")
PARSE = {"ledger": "xdr_parse_ledger", "transactions": "xdr_parse_tx", "results": "xdr_parse_result", "scp": "xdr_parse_scp"}
_current: ContextVar[Phases | None] = ContextVar("phases", default=None)


@dataclass
class Phases:
    """Sums by phase; ``table`` gives them once the operation's tables were made."""

    waiting: list[Observation] = field(default_factory=list)
    timed: dict[str, list[float]] = field(default_factory=dict)

    def add(self, phase: str, calls: int, size: int, seconds: float) -> None:
        sums = self.timed.setdefault(phase, [0, 0, 0.0])
        for k, x in enumerate((calls, size, seconds)):
            sums[k] += x

    def table(self) -> dict[str, dict[str, float]]:
        """{phase: calls, bytes, seconds} of all phases."""
        for observation in self.waiting:
            found = observation.get
            for phase in PHASES:
                if found.get(f"{phase}.calls"):
                    self.add(phase, found[f"{phase}.calls"], found[f"{phase}.bytes"] or 0, (found[f"{phase}.ns"] or 0) / 1e9)
        self.waiting = []
        return {p: dict(zip(("calls", "bytes", "seconds"), self.timed.get(p, [0, 0, 0.0]), strict=True)) for p in PHASES}

    def lines(self) -> list[str]:
        table = self.table()
        whole = sum(x["seconds"] for x in table.values()) or 1.0
        out = [f"{'phase':18} {'calls':>9} {'MB':>10} {'s':>10} {'%':>6} {'MB/s':>9}"]
        for phase, x in table.items():
            rate = x["bytes"] / 1e6 / x["seconds"] if x["seconds"] else 0.0
            out.append(f"{phase:18} {x['calls']:9.0f} {x['bytes'] / 1e6:10.2f} {x['seconds']:10.3f} {100 * x['seconds'] / whole:6.1f} {rate:9.1f}")
        return out


@contextlib.contextmanager
def recorded() -> Iterator[Phases]:
    """Tables watched inside add to the phases given."""
    phases = Phases()
    token = _current.set(phases)
    try:
        yield phases
    finally:
        _current.reset(token)


def watched(df: DataFrame, **phases: tuple[Column, Column, Column]) -> DataFrame:
    """``df`` whose rows add (condition, bytes, nanoseconds) to phases when they are next computed; compute them once."""
    current = _current.get()
    if current is None:
        return df
    observation = Observation()
    sums = []
    for phase, (condition, size, ns) in phases.items():
        sums += [F.count_if(condition).alias(f"{phase}.calls"), F.sum(F.when(condition, size)).alias(f"{phase}.bytes"), F.sum(F.when(condition, ns)).alias(f"{phase}.ns")]
    current.waiting.append(observation)
    return df.observe(observation, *sums)


def watched_files(df: DataFrame, copied: bool) -> DataFrame:
    """``decoded`` rows, with their phases."""
    kind, c = F.col("kind"), F.col
    xdr = kind.isin(*PARSE)
    more = {PARSE[k]: (kind == k, c("bytes_out"), c("parse_ns")) for k in PARSE}
    if copied:
        more["copy"] = (c("parsed"), c("bytes_in"), c("write_ns"))
    return watched(df, bucket_stream=(kind == "bucket", c("bytes_in"), c("fetch_ns") + c("decompress_ns") + c("parse_ns")), xdr_decompress=(xdr, c("bytes_out"), c("fetch_ns") + c("decompress_ns")), **more)


@contextlib.contextmanager
def timed(phase: str, calls: int = 1) -> Iterator[None]:
    """The driver's time inside goes to a phase."""
    began = time.perf_counter()
    yield
    if (current := _current.get()) is not None:
        current.add(phase, calls, 0, time.perf_counter() - began)
