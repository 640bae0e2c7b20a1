"""Archives: where they lie, and their files as DataFrames.

An archive is a store (``stores``) with a root. Whether expected files are there,
and what they hold, is asked by the tasks that own the expected rows: no path
passes the driver, and no listing is held there. Where listing a folder is
cheaper than asking for each of its files, as in object stores, expected paths
are brought together by folder, and a folder with many of them is listed once.
"""

from __future__ import annotations

import contextlib
import os
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from itertools import groupby
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stores import FATAL, HADOOP_SCHEMES, NOT_FOUND, RETRY, RETRY_STATUS, STORES, ArrowStore, FileStore, HttpStore, Options, StorageError, Store, os_error_class, register, status_class, with_retries

#: Expected files of a folder from which on it is listed, in stores that prefer it.
LIST_FROM = 16
#: Bytes of a file read as one value; history files are far smaller.
MOST_VALUE = 64 << 20


def status_class_column(status: Column) -> Column:
    """``status_class`` of a column of HTTP states, 100 to 599."""
    status = status.cast("int")
    known = F.when(status == 404, NOT_FOUND).when(status.isin(*RETRY_STATUS), RETRY).when(status.between(400, 499), FATAL).otherwise(RETRY)
    return F.when(status.between(100, 599), known)


def with_presence(expected: DataFrame, there: DataFrame, on: str = "path") -> DataFrame:
    """``expected`` with ``present``, and class and text of the error of what is not; ``there`` has one row for each key."""
    found = there.select(on, F.lit(True).alias("present"))
    out = expected.join(found, on, "left").withColumn("present", F.coalesce("present", F.lit(False)))
    return out.withColumns({"error_class": F.when(~F.col("present"), NOT_FOUND), "error": F.when(~F.col("present"), "not found")})


class Pace:
    """Holds a task back to a number of bytes a second, over all its files."""

    def __init__(self, limit: float):
        self.limit, self.began, self.size = limit, time.monotonic(), 0

    def __call__(self, size: int) -> None:
        self.size += size
        time.sleep(max(0.0, self.size / self.limit - (time.monotonic() - self.began)))


@dataclass(frozen=True)
class Archive:
    """An archive's root: ``scheme`` is file, http, a Hadoop scheme or a registered one; ``root`` a path or URL without a slash at its end."""

    scheme: str
    root: str
    options: Options = field(default_factory=Options)
    given: Store | None = field(default=None, repr=False)

    @property
    def store(self) -> Store:
        if self.given is not None:
            return self.given
        if self.scheme == "file":
            return FileStore(self.root, self.options)
        if self.scheme == "http":
            return HttpStore(self.root, self.options)
        return ArrowStore(urlparse(self.root).scheme, self.root, None, self.options)

    @property
    def writable(self) -> bool:
        return self.store.writable

    def key(self, path: str) -> str:
        return f"{self.root}/{path.lstrip('/')}"

    # single files, on the driver or in a task

    def read(self, path: str, retries: bool = True) -> bytes:
        """A file as one value, of ``MOST_VALUE`` bytes at most."""
        out = bytearray()
        for piece in self.store.ranges(path, retries=retries):
            out += piece
            if len(out) > MOST_VALUE:
                raise StorageError(FATAL, f"{path}: longer than {MOST_VALUE} bytes")
        return bytes(out)

    def exists(self, path: str) -> bool:
        """Whether a file of more than no bytes is there."""
        try:
            return self.store.size(path) > 0
        except StorageError as e:
            if e.kind == NOT_FOUND:
                return False
            raise

    def write(self, path: str, data: bytes) -> None:
        """Whole or not at all; two attempts of one task do not meet, as each has its own temporary name."""
        staged = self.store.stage(path)
        try:
            staged.write(data)
        except BaseException:
            staged.abort()
            raise
        staged.commit()

    # many files, as DataFrames

    def paced(self, files: DataFrame) -> tuple[DataFrame, Callable[[], Pace | None]]:
        """``files`` dealt out so that tasks together keep to the bandwidth limit, and what each of them keeps to.

        There are as many partitions as the cluster has cores now, each with an
        equal share: however many of them run at once, they stay at the limit.
        """
        limit = self.options.bandwidth_limit
        if not limit:
            return files, lambda: None
        n = max(1, files.sparkSession.sparkContext.defaultParallelism)
        return files.repartition(n), lambda: Pace(limit / n)

    def listing(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        """(path, length) of all files below the folders, listed by tasks: two levels of folders are dealt out first."""
        store = self.store

        def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    found = [(path, length)] if length is not None else list(store.children(path))
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["path", "length"])

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    found = [(path, length)] if length is not None else list(store.walk(path))
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["path", "length"])

        ddl = "path string, length long"
        out = spark.createDataFrame([(f, None) for f in folders], ddl)
        for _ in range(2):
            out = out.mapInArrow(children, ddl).repartition("path")
        return out.mapInArrow(walk, ddl)

    def present(self, expected: DataFrame) -> DataFrame:
        """``expected(path, ...)`` with ``present``, error_class and error: a refused or failed request is no missing file."""
        store, columns = self.store, expected.columns
        deep = F.size(F.split("path", "/")) > 3
        folder = F.when(deep, F.substring_index("path", "/", 3)).otherwise(F.regexp_replace("path", "/?[^/]*$", ""))
        if store.lists:
            expected = expected.withColumn("__folder", folder).repartition("__folder").sortWithinPartitions("__folder").drop("__folder")
        at = columns.index("path")
        # the tasks' own rule for a folder: the same as the column's
        folder_of = lambda p: "/".join(p.split("/")[: 3 if p.count("/") > 2 else -1])

        def one(path: str) -> tuple[bool, str | None, str | None]:
            try:
                there = self.exists(path)
                return there, None if there else NOT_FOUND, None if there else "not found"
            except StorageError as e:
                return False, e.kind, str(e)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for under, paths in groupby(batch.column(at).to_pylist(), folder_of if store.lists else lambda _: None):
                    some = list(paths)
                    if store.lists and len(some) >= LIST_FROM:
                        with contextlib.suppress(StorageError):  # then each is asked for, and tells its own error
                            there = with_retries(lambda f=under: {p for p, size in store.walk(f) if size}, self.options)
                            found += [(True, None, None) if p in there else (False, NOT_FOUND, "not found") for p in some]
                            continue
                    found += map(one, some)
                more = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.bool_(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*columns, "present", "error_class", "error"])

        return expected.mapInArrow(run, f"{_ddl(expected)}, present boolean, error_class string, error string")

    def contents(self, expected: DataFrame) -> DataFrame:
        """``expected(path, ...)`` with content, error_class and error; for small files, as values. Others are decoded as they are read."""
        expected, paced = self.paced(expected)
        columns, store = expected.columns, self.store
        at = columns.index("path")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pace = paced()
            for batch in batches:
                for i, path in enumerate(batch.column(at).to_pylist()):
                    began, more = time.perf_counter_ns(), (None, None, None)
                    try:
                        content = bytearray()
                        for piece in store.ranges(path, pace):
                            content += piece
                            if len(content) > MOST_VALUE:
                                raise StorageError(FATAL, f"{path}: longer than {MOST_VALUE} bytes")
                        more = (bytes(content), None, None)
                    except StorageError as e:
                        more = (None, e.kind, str(e))
                    one = batch.slice(i, 1)
                    types = (pa.binary(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([*one.columns, *(pa.array([x], t) for x, t in zip((*more, time.perf_counter_ns() - began), types, strict=True))], names=[*columns, "content", "error_class", "error", "fetch_ns"])

        return expected.mapInArrow(run, f"{_ddl(expected)}, content binary, error_class string, error string, fetch_ns bigint")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def hadoop_settings(scheme: str, environ: Mapping[str, str] = os.environ) -> dict[str, str]:
    """Hadoop configuration for a URL's scheme from the usual environment variables, for Spark's own readers."""
    get = environ.get
    out: dict[str, str | None] = {}
    if scheme in ("s3", "s3a"):
        out = {"fs.s3a.endpoint.region": get("AWS_REGION"), "fs.s3a.endpoint": get("S3_ENDPOINT"), "fs.s3a.access.key": get("AWS_ACCESS_KEY_ID"), "fs.s3a.secret.key": get("AWS_SECRET_ACCESS_KEY")}
    elif scheme == "b2":
        missing = [k for k in ("B2_BUCKET_ID", "B2_APPLICATION_KEY_ID", "B2_APPLICATION_KEY") if not get(k)]
        if missing:
            raise StorageError(FATAL, f"b2 needs {', '.join(missing)}")
        out = {"fs.s3a.endpoint": get("S3_ENDPOINT"), "fs.s3a.access.key": get("B2_APPLICATION_KEY_ID"), "fs.s3a.secret.key": get("B2_APPLICATION_KEY"), "fs.s3a.path.style.access": "true"}
    elif scheme in ("gs", "gcs"):
        out = {"fs.gs.auth.service.account.json.keyfile": get("GOOGLE_APPLICATION_CREDENTIALS")}
    elif scheme in ("azblob", "azure", "abfss", "wasbs") and get("AZURE_STORAGE_ACCOUNT"):
        host = get("AZURE_STORAGE_ENDPOINT") or f"{get('AZURE_STORAGE_ACCOUNT')}.dfs.core.windows.net"
        out = {f"fs.azure.account.key.{host.removeprefix('https://').rstrip('/')}": get("AZURE_STORAGE_KEY")}
    return {k: v for k, v in out.items() if v}


def configure(spark: SparkSession, url: str) -> None:
    """Hand a URL's settings to Spark's Hadoop configuration."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for k, v in hadoop_settings(urlparse(url).scheme.lower()).items():
        conf.set(k, v)


def archive(url: str, options: Options | None = None) -> Archive:
    """The archive at a URL: file, http(s), an object store, Hadoop's filesystems, swift, sftp, or a registered scheme."""
    options = options or Options()
    if "://" not in url:
        raise StorageError(FATAL, f"no URL: {url}")
    if url.lower().startswith("file:"):
        url = url.replace("\\", "/")
    parsed = urlparse(url)
    scheme = parsed.scheme.lower()
    if scheme not in STORES:
        raise StorageError(FATAL, f"unknown scheme: {scheme}")
    if scheme == "file":
        root = os.path.normpath(unquote(parsed.path)).rstrip("/")
        return Archive("file", root, options, STORES["file"](root, options))
    if scheme in ("http", "https"):
        root = f"{scheme}://{parsed.netloc}{parsed.path}".rstrip("/")
        return Archive("http", root, options, STORES[scheme](root, options))
    if scheme in ("azblob", "azure") and "@" not in parsed.netloc and os.environ.get("AZURE_STORAGE_ACCOUNT"):
        parsed = parsed._replace(netloc=f"{parsed.netloc}@{os.environ['AZURE_STORAGE_ACCOUNT']}.dfs.core.windows.net")
    if scheme in HADOOP_SCHEMES:
        root = f"{HADOOP_SCHEMES[scheme]}://{parsed.netloc}{parsed.path}".rstrip("/")
        return Archive(HADOOP_SCHEMES[scheme], root, options, STORES[scheme](root, options))
    return Archive(scheme, url.rstrip("/"), options, STORES[scheme](url, options))


__all__ = ["FATAL", "NOT_FOUND", "RETRY", "Archive", "Options", "StorageError", "Store", "archive", "configure", "os_error_class", "register", "status_class", "status_class_column", "with_presence", "with_retries"]
