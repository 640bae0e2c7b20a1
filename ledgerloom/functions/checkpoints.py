"""Checkpoint arithmetic, archive paths and hashes as Spark expressions.

All take and return columns; ledgers are bigint, so nothing overflows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FREQUENCY = 64
FIRST = FREQUENCY - 1
# File kinds of a checkpoint and their bits, in report order.
KIND_FLAGS = {"history": 1, "ledger": 2, "transactions": 4, "results": 8, "scp": 16}
OPTIONAL_KIND = "scp"
ZERO_HASH = "0" * 64
#: SHA-256 of an empty XDR array (four zero bytes).
EMPTY_ARRAY_HASH = "df3f619804a92fdb4057192dc43dd748ea778adc52bc498ce80524c014b81119"
BUCKET_PATTERN = "^bucket/(?:.*/)?[^/]*\\.xdr\\.gz$"


def _div(x: Column, by: int) -> Column:
    return F.floor(x / by).cast("bigint")


def is_checkpoint(ledger: Column) -> Column:
    return (ledger > 0) & ((ledger + 1) % FREQUENCY == 0)


def floor_checkpoint(ledger: Column) -> Column:
    """The last checkpoint at or before a ledger; the first one for earlier ledgers."""
    return F.greatest(F.lit(FIRST).cast("bigint"), _div(ledger + 1, FREQUENCY) * FREQUENCY - 1)


def ceil_checkpoint(ledger: Column) -> Column:
    return _div(ledger, FREQUENCY) * FREQUENCY + FREQUENCY - 1


def count_checkpoints(low: Column, high: Column) -> Column:
    """Checkpoints from low to high; an error where either is none."""
    counted = F.when(high < low, 0).otherwise(_div(high - low, FREQUENCY) + 1).cast("bigint")
    wrong = ~is_checkpoint(low) | ~is_checkpoint(high)
    return F.when(wrong, F.raise_error(F.lit("not a checkpoint")).cast("bigint")).otherwise(counted)


def first_ledger(cp: Column) -> Column:
    """The first ledger of a checkpoint: 1 for the first one, whose ledger 0 does not exist."""
    return F.when(cp == FIRST, 1).otherwise(cp - FIRST).cast("bigint")


def _hex8(cp: Column) -> Column:
    return F.lower(F.lpad(F.hex(cp), 8, "0"))


def checkpoint_prefix(cp: Column) -> Column:
    h = _hex8(cp)
    return F.concat_ws("/", F.substring(h, 1, 2), F.substring(h, 3, 2), F.substring(h, 5, 2))


def checkpoint_path(kind: Column, cp: Column) -> Column:
    ending = F.when(kind == "history", ".json").otherwise(".xdr.gz")
    return F.concat(kind, F.lit("/"), checkpoint_prefix(cp), F.lit("/"), kind, F.lit("-"), _hex8(cp), ending)


def hash_prefix(h: Column) -> Column:
    """The folders of a hash; null for fewer than six characters."""
    return F.when(F.length(h) >= 6, F.concat_ws("/", F.substring(h, 1, 2), F.substring(h, 3, 2), F.substring(h, 5, 2)))


def bucket_path(h: Column) -> Column:
    """The path of a bucket, in the hash's own case."""
    return F.concat(F.lit("bucket/"), hash_prefix(h), F.lit("/bucket-"), h, F.lit(".xdr.gz"))


def is_valid_hash(h: Column) -> Column:
    """64 hexadecimal digits of either case; cheaper than a pattern, as it is asked of every hash."""
    return (F.length(h) == 64) & (F.translate(h, "0123456789abcdefABCDEF", "") == "")


def is_zero_hash(h: Column) -> Column:
    return h == ZERO_HASH


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def checkpoint_from_path(path: Column) -> Column:
    """The checkpoint in a file's name (hexadecimal after the last dash); null if there is none."""
    digits = F.regexp_extract(_name(path), "-([0-9a-fA-F]{1,8})(?:\\.[^-]*)?$", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("bigint"))


def hash_from_path(path: Column) -> Column:
    """The bucket hash in a file's name, in lower case; null if there is none."""
    found = F.lower(F.regexp_extract(_name(path), "^bucket-([0-9a-fA-F]{64})(?:\\.|$)", 1))
    return F.when(found != "", found)


def is_bucket_path(path: Column) -> Column:
    return path.startswith("bucket/") & path.endswith(".xdr.gz") & hash_from_path(path).isNotNull()


def kind_of_path(path: Column) -> Column:
    """history, ledger, transactions, results, scp or bucket; null for other paths."""
    out = F.when(path.startswith("history/") & F.lower(path).endswith(".json"), "history").when(is_bucket_path(path), "bucket")
    for kind in ("ledger", "transactions", "results", "scp"):
        out = out.when(path.startswith(f"{kind}/") & path.endswith(".xdr.gz"), kind)
    return out


def flag_of_kind(kind: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, flag in KIND_FLAGS.items():
        out = F.when(kind == name, flag).otherwise(out)
    return out


def has_flag(flags: Column, flag: int) -> Column:
    return flags.bitwiseAND(F.lit(flag)) != 0


def set_flag(flags: Column, flag: int) -> Column:
    return flags.bitwiseOR(F.lit(flag))


def unset_flag(flags: Column, flag: int) -> Column:
    return flags.bitwiseAND(F.lit(~flag))


def flag_names(flags: Column) -> Column:
    """The kinds of a bit set, in report order."""
    return F.filter(F.array(*(F.when(has_flag(flags, bit), F.lit(name)) for name, bit in KIND_FLAGS.items())), lambda n: n.isNotNull())


def empty_tx_set_hashes(prev_hash: Column) -> tuple[Column, Column]:
    """Hashes of an empty transaction set after ``prev_hash``: of the first form, and of the general one."""
    raw = F.unhex(prev_hash)
    return F.sha2(raw, 256), F.sha2(F.concat(F.unhex(F.lit("00000001")), raw, F.unhex(F.lit("00000000"))), 256)


def is_empty_tx_set_hash(h: Column, prev_hash: Column) -> Column:
    first, general = empty_tx_set_hashes(prev_hash)
    return is_zero_hash(h) | (h == first) | (h == general)
