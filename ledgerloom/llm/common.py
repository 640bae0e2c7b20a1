"""What the corpus operators share: tables, the shared folder, small numpy helpers."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans.shipping import ship

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset a local one serves a local master; a cluster needs a shared one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder in place of recomputation or a lineage.

    An intermediate table can be dropped once the tables made from it are
    written; a table behind a lazily returned result stays.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/ledgerloom/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        with cleaned_shuffles(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *kept: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in kept:
            path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def cleaned_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go as soon as each query ends."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) as (node, smallest node reachable) for each node that is not itself the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right, low = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        least = np.minimum(low[left], low[right])
        new = low.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        np.minimum.at(new, low[left], least)
        np.minimum.at(new, low[right], least)
        new = new[new]
        if np.array_equal(new, low):
            break
        low = new
    moved = low != np.arange(len(nodes))
    return nodes[moved], nodes[low[moved]]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def sql_crc32(codes: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a list of bytes, given as BIGINTs."""
    step = "CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    return f"xor(list_reduce({codes}, lambda c, b: list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda a, k: {step}, xor(c, b)), CAST(4294967295 AS BIGINT)), 4294967295)"
