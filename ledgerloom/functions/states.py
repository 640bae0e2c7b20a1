"""Rules for history states as Spark expressions: validation, and the buckets a state refers to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .checkpoints import is_checkpoint, is_valid_hash, is_zero_hash

LEVELS = 11
NEXT = T.StructType([
    T.StructField("state", T.LongType()),
    T.StructField("output", T.StringType()),
    T.StructField("curr", T.StringType()),
    T.StructField("snap", T.StringType()),
    T.StructField("shadow", T.ArrayType(T.StringType())),
])
LEVEL = T.StructType([T.StructField("curr", T.StringType()), T.StructField("snap", T.StringType()), T.StructField("next", NEXT)])
STATE = T.StructType([
    T.StructField("version", T.LongType()),
    T.StructField("server", T.StringType()),
    T.StructField("currentLedger", T.LongType()),
    T.StructField("networkPassphrase", T.StringType()),
    T.StructField("currentBuckets", T.ArrayType(LEVEL)),
    T.StructField("hotArchiveBuckets", T.ArrayType(LEVEL)),
])


def _level_error(level: Column) -> Column:
    """The first rule that a level breaks, or null."""
    nxt = level["next"]
    state, output = nxt["state"], nxt["output"]
    inputs = nxt["curr"].isNotNull() | nxt["snap"].isNotNull() | nxt["shadow"].isNotNull()
    hexed = lambda c: F.coalesce(is_valid_hash(c), F.lit(False))
    return F.coalesce(
        F.when(~hexed(level["curr"]), F.lit("curr is not a hash")),
        F.when(~hexed(level["snap"]), F.lit("snap is not a hash")),
        F.when((state == 0) & (output.isNotNull() | inputs), F.lit("state 0 has fields")),
        F.when((state == 1) & ~hexed(output), F.lit("state 1 needs an output hash")),
        F.when((state == 1) & inputs, F.lit("state 1 has inputs")),
        F.when((state == 2) & ~(hexed(nxt["curr"]) & hexed(nxt["snap"])), F.lit("state 2 needs curr and snap hashes")),
        F.when((state == 2) & F.coalesce(F.exists(nxt["shadow"], lambda s: ~hexed(s)), F.lit(False)), F.lit("shadow is not a hash")),
        F.when(~F.coalesce(state.isin(0, 1, 2), F.lit(False)), F.lit("unknown state")),
    )


def _plain(levels: Column) -> Column:
    """Whether all levels are in state 0 or 1 and hold what that asks for: lengths level by level, digits of all hashes at once."""
    nxt = lambda level: level["next"]
    no_inputs = lambda level: nxt(level)["curr"].isNull() & nxt(level)["snap"].isNull() & nxt(level)["shadow"].isNull()
    output = lambda level: ((nxt(level)["state"] == 0) & nxt(level)["output"].isNull()) | ((nxt(level)["state"] == 1) & (F.length(nxt(level)["output"]) == 64))
    sized = F.forall(levels, lambda level: (F.length(level["curr"]) == 64) & (F.length(level["snap"]) == 64) & output(level) & no_inputs(level))
    digits = F.array_join(F.transform(levels, lambda level: F.concat(level["curr"], level["snap"], F.coalesce(nxt(level)["output"], F.lit("")))), "")
    return F.coalesce(sized, F.lit(False)) & ~digits.rlike("[^0-9a-fA-F]")


def _levels_error(levels: Column, name: str) -> Column:
    """The first rule that a level breaks; levels that are plain are not looked at one by one."""
    found = F.filter(F.transform(levels, lambda level, i: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]: "), _level_error(level))), lambda e: e.isNotNull())
    return F.when(levels.isNotNull() & ~_plain(levels), F.get(found, F.lit(0)))


def state_error(state: Column) -> Column:
    """The first rule that a history state breaks, or null."""
    version, hot, cp = state["version"], state["hotArchiveBuckets"], state["currentLedger"]
    return F.coalesce(
        F.when(~F.coalesce(version.isin(1, 2), F.lit(False)), F.lit("unsupported version")),
        F.when((version == 2) & hot.isNull(), F.lit("version 2 needs hot archive buckets")),
        F.when((version == 1) & hot.isNotNull(), F.lit("version 1 has hot archive buckets")),
        F.when(~F.coalesce(is_checkpoint(cp), F.lit(False)), F.lit("current ledger is not a checkpoint")),
        _levels_error(state["currentBuckets"], "currentBuckets"),
        _levels_error(hot, "hotArchiveBuckets"),
    )


def bucket_hashes(state: Column) -> Column:
    """Distinct hashes of the buckets needed: curr, snap and next.output of all levels, without empty and zero ones."""
    levels = F.concat(state["currentBuckets"], F.coalesce(state["hotArchiveBuckets"], F.array().cast(T.ArrayType(LEVEL))))
    found = F.flatten(F.transform(levels, lambda level: F.array(level["curr"], level["snap"], level["next"]["output"])))
    return F.array_sort(F.array_distinct(F.filter(found, lambda h: h.isNotNull() & (h != "") & ~is_zero_hash(h))))
