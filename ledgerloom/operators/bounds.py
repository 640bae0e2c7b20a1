"""Checkpoint bounds of the operations, as columns: of many archives at once, or of one before its run."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import checkpoints as cps
from ledgerloom.functions.checkpoints import FIRST, FREQUENCY


class BoundsError(ValueError):
    pass


class GapDetected(BoundsError):
    """A mirror would start after the end of its destination."""


def floor_checkpoint(ledger: int) -> int:
    return max(FIRST, (ledger + 1) // FREQUENCY * FREQUENCY - 1)


def ceil_checkpoint(ledger: int) -> int:
    return ledger // FREQUENCY * FREQUENCY + FREQUENCY - 1


def is_checkpoint(ledger: int) -> bool:
    return ledger > 0 and (ledger + 1) % FREQUENCY == 0


@dataclass(frozen=True)
class Bounds:
    """An inclusive range of checkpoints; empty if low is above high."""

    low: int
    high: int

    @property
    def empty(self) -> bool:
        return self.low > self.high

    @property
    def count(self) -> int:
        return 0 if self.empty else (self.high - self.low) // FREQUENCY + 1


GAP, BELOW, ABOVE = "gap", "below", "above"


def archive_bounds_column(latest: Column, low: Column, high: Column) -> Column:
    """struct(low, high, error, warning): low is rounded down, high up; high is cut at the archive's last checkpoint. Nulls stand for no limit."""
    first = F.when(low.isNull(), FIRST).otherwise(cps.floor_checkpoint(low)).cast("bigint")
    asked = F.when(high.isNull(), latest).otherwise(cps.ceil_checkpoint(high))
    last = F.least(asked, latest).cast("bigint")
    error = F.when(first > latest, BELOW).when(first > last, ABOVE)
    warning = F.when(asked > latest, F.concat(F.lit("high "), asked.cast("string"), F.lit(" is beyond the archive's end "), latest.cast("string")))
    return F.struct(first.alias("low"), last.alias("high"), error.alias("error"), warning.alias("warning"))


def mirror_bounds_column(latest: Column, existing: Column, low: Column, high: Column, overwrite: Column, allow_gaps: Column) -> Column:
    """struct(low, high, error, warning): where a mirror goes on. ``existing`` is the destination's checkpoint, null if it has none."""
    whole = archive_bounds_column(latest, low, high)
    after, last = (existing + FREQUENCY).cast("bigint"), whole["high"]
    done = F.coalesce(existing >= last, F.lit(False)) & ~overwrite
    ahead = low.isNotNull() & (whole["low"] > existing)
    behind = low.isNotNull() & existing.isNotNull() & ~overwrite & (whole["low"] <= existing)
    start = F.when(done, last + FREQUENCY).when(low.isNull() & existing.isNotNull() & ~overwrite, after).when(behind, after).otherwise(whole["low"])
    error = F.coalesce(whole["error"], F.when(~done & F.coalesce(ahead, F.lit(False)) & ~allow_gaps, GAP))
    warning = F.coalesce(whole["warning"], F.when(~done & behind, F.concat(F.lit("the destination already reaches "), existing.cast("string"), F.lit(": going on after it"))))
    return F.struct(start.alias("low"), last.alias("high"), error.alias("error"), warning.alias("warning"))


def _resolved(bounds: Column, latest: int, low: int | None) -> Bounds:
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    b = spark.range(1).select(bounds.alias("b")).select("b.*").first()
    if b.error == BELOW:
        raise BoundsError(f"the archive ends at checkpoint {latest}, below {b.low}")
    if b.error == ABOVE:
        raise BoundsError(f"low {b.low} is above high {b.high}")
    if b.error == GAP:
        raise GapDetected(f"starting at {b.low} leaves a gap after the destination's end")
    if b.warning:
        warnings.warn(b.warning, stacklevel=3)
    return Bounds(b.low, b.high)


def _number(x: int | None) -> Column:
    return F.lit(x).cast("bigint")


def archive_bounds(latest: int, low: int | None = None, high: int | None = None) -> Bounds:
    """``archive_bounds_column`` of one archive; raises ``BoundsError``."""
    return _resolved(archive_bounds_column(*map(_number, (latest, low, high))), latest, low)


def mirror_bounds(latest: int, existing: int | None, low: int | None = None, high: int | None = None, overwrite: bool = False, allow_gaps: bool = False) -> Bounds:
    """``mirror_bounds_column`` of one pair of archives; raises ``BoundsError``."""
    return _resolved(mirror_bounds_column(*map(_number, (latest, existing, low, high)), F.lit(overwrite), F.lit(allow_gaps)), latest, low)
