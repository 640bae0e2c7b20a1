"""Failure sets as a DataFrame ``(kind, cp, flag, hash)``: kind is file, bucket or checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.checkpoints import KIND_FLAGS, bucket_path, checkpoint_path, flag_names, flag_of_kind, hash_from_path, kind_of_path

DDL = "kind string, cp bigint, flag int, hash string"


def of_paths(failed: DataFrame) -> DataFrame:
    """Failures of ``failed(path, cp)``; paths of no known kind are ignored."""
    kind = kind_of_path(F.col("path"))
    bucket = kind == "bucket"
    return failed.where(kind.isNotNull()).select(
        F.when(bucket, "bucket").otherwise("file").alias("kind"), F.when(~bucket, F.col("cp")).alias("cp"), flag_of_kind(kind).alias("flag"), hash_from_path(F.col("path")).alias("hash")
    ).distinct()


def of_checkpoints(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.select(F.lit("checkpoint").alias("kind"), "cp", F.lit(None).cast("int").alias("flag"), F.lit(None).cast("string").alias("hash")).distinct()


def file_flags(failures: DataFrame) -> DataFrame:
    """(cp, flags): failed files of each checkpoint as bits."""
    return failures.where("kind = 'file'").groupBy("cp").agg(F.bit_or("flag").alias("flags"))


def count_kind(flags: DataFrame, flag: int) -> DataFrame:
    return flags.agg(F.count_if(F.col("flags").bitwiseAND(F.lit(flag)) != 0).alias("n"))


def summary(outcomes: DataFrame, failures: DataFrame) -> DataFrame:
    """One row: succeeded, skipped, failed (files and buckets, not checkpoints), retries (always 0)."""
    counted = outcomes.agg(F.count_if(F.col("outcome") == "processed").alias("succeeded"), F.count_if(F.col("outcome") == "skipped").alias("skipped"))
    failed = failures.agg(F.count_if(F.col("kind").isin("file", "bucket")).alias("failed"))
    # two rows of one: each side is an aggregate
    return counted.withColumn("k", F.lit(1)).join(failed.withColumn("k", F.lit(1)), "k").select("succeeded", "skipped", "failed", F.lit(0).cast("bigint").alias("retries"))


def work_list(failures: DataFrame) -> DataFrame:
    """(cp, path, kind) of single files to fetch again.

    Files of a checkpoint that is fetched whole anyway are left out, but for its
    history file, which leads to buckets. Buckets have no checkpoint: 0.
    """
    files = failures.where("kind = 'file'").join(failures.where("kind = 'checkpoint'").select("cp", F.lit(True).alias("whole")).distinct(), "cp", "left")
    files = files.where(F.col("whole").isNull() | (F.col("flag") == KIND_FLAGS["history"]))
    name = F.element_at(flag_names(F.col("flag")), 1)
    files = files.select("cp", checkpoint_path(name, F.col("cp")).alias("path"), name.alias("kind"))
    buckets = failures.where("kind = 'bucket'").select(F.lit(0).cast("bigint").alias("cp"), bucket_path(F.col("hash")).alias("path"), F.lit("bucket").alias("kind"))
    return files.union(buckets).distinct()


def without(failures: DataFrame, mended: DataFrame) -> DataFrame:
    """Set difference."""
    return failures.exceptAll(mended.select(*failures.columns))
