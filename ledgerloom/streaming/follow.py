"""Following an archive as it grows, with Structured Streaming.

New history files are read as they appear, each once; the stream's checkpoint
remembers which. A batch adds the states' buckets and the files expected with
them to a table; a bucket that an earlier state needs already is left out by a
join with that table, so its size does not bear on the stream's state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.functions.checkpoints import checkpoint_from_path
from ledgerloom.functions.states import state_error
from ledgerloom.plans.operations import checkpoint_files, needed_buckets
from ledgerloom.plans.shipping import ship
from ledgerloom.sources.decode import parsed_states
from ledgerloom.sources.storage import Archive

BINARY = "path string, modificationTime timestamp, length bigint, content binary"
TABLE = "cp bigint, kind string, path string"


def new_states(spark: SparkSession, archive: Archive) -> DataFrame:
    """Streaming (path, cp, state, error_class, error) of history files as they appear."""
    ship(spark)
    root = f"file://{archive.root}" if archive.scheme == "file" else archive.root
    files = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("pathGlobFilter", "history-*.json").load(f"{root}/history")
    none = F.lit(None).cast("string")
    read = parsed_states(files.select("path", checkpoint_from_path(F.col("path")).alias("cp"), "content", none.alias("error_class"), none.alias("error"))).drop("content")
    broken = state_error(F.col("state"))
    return read.withColumns({"error_class": F.coalesce("error_class", F.when(broken.isNotNull(), "fatal")), "error": F.coalesce("error", broken)})


def follow(spark: SparkSession, archive: Archive, table: str, checkpoint: str, skip_optional: bool = False) -> StreamingQuery:
    """Append the files that newly appeared states need to the Parquet table at ``table``; ends when all are read.

    A batch that runs again after a failure writes its own folder anew.
    """

    def add(batch: DataFrame, number: int) -> None:
        good = batch.where("error_class IS NULL").select("cp", "state")
        files = checkpoint_files(good.select("cp").distinct(), skip_optional)
        known = spark.read.schema(TABLE + ", batch bigint").option("basePath", table).parquet(table).where((F.col("batch") != number) & (F.col("kind") == "bucket")) if number else None
        buckets = needed_buckets(good)
        if known is not None:
            buckets = buckets.join(known.select("path"), "path", "left_anti")
        out = files.select("cp", "kind", "path").unionByName(buckets.select("cp", "kind", "path"))
        out.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return new_states(spark, archive).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
