"""Stores: the places that hold an archive's files, as tasks see them.

A store opens a file from a byte on, tells its size, lists what lies below a
folder, and takes new files in two steps: staged under a name of its own for
each attempt, then committed or aborted. Everything runs where a file is
wanted, in the tasks; the driver hands out paths only.

File archives are read by the operating system, HTTP and Swift by requests, and
object stores by Arrow's filesystems (s3a, gs, abfss; hdfs and viewfs by its
Hadoop client, which needs libhdfs on the executors). Others are added with
``register``; tasks get their code along with the store.
"""

from __future__ import annotations

import contextlib
import errno
import http.client
import importlib.util
import io
import json
import os
import re
import sys
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache
from http.client import HTTPException
from urllib.parse import quote, unquote, urlparse

RETRY, FATAL, NOT_FOUND = "retry", "fatal", "not_found"
# HTTP states worth another try.
RETRY_STATUS = (408, 429, 500, 502, 503, 504, 509, 520, 521, 522, 523, 524, 529, 530, 598, 599)
FATAL_ERRNO = (errno.EACCES, errno.EPERM, errno.EEXIST, errno.EINVAL)
#: Longest delay between two tries, in seconds.
MOST_DELAY = 5.0


class StorageError(Exception):
    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind

    def __reduce__(self):
        return StorageError, (self.kind, str(self))


def status_class(status: int) -> str:
    if status == 404:
        return NOT_FOUND
    if status in RETRY_STATUS:
        return RETRY
    return FATAL if 400 <= status < 500 else RETRY


def os_error_class(e: OSError) -> str:
    """The class of an operating system's or Arrow's error; the latter tell HTTP states in their text."""
    if e.errno == errno.ENOENT or isinstance(e, FileNotFoundError):
        return NOT_FOUND
    if e.errno is None and (told := re.search(r"HTTP (?:status|response code) (\d{3})", str(e))):
        return status_class(int(told.group(1)))
    if "ACCESS_DENIED" in str(e):
        return FATAL
    return FATAL if e.errno in FATAL_ERRNO else RETRY


@contextlib.contextmanager
def told(path: str) -> Iterator[None]:
    """Errors inside become storage errors of the path."""
    try:
        yield
    except urllib.error.HTTPError as e:
        raise StorageError(status_class(e.code), f"{path}: status {e.code}") from e
    except (urllib.error.URLError, HTTPException, ValueError) as e:
        raise StorageError(RETRY, f"{path}: {e}") from e
    except OSError as e:
        raise StorageError(os_error_class(e), f"{path}: {e.strerror or e}") from e


@dataclass(frozen=True)
class Options:
    """I/O options. ``retry_max_delay`` is accepted and not used: delays are capped at ``MOST_DELAY``."""

    max_retries: int = 3
    retry_min_delay: float = 0.1
    retry_max_delay: float = 30.0
    timeout: float = 30.0
    io_timeout: float = 300.0
    bandwidth_limit: int = 0
    atomic_file_writes: bool = False
    user_agent: str = "ledgerloom/0.1"
    #: Bytes of a file that a task holds at once.
    range_bytes: int = 8 << 20


def delays(options: Options) -> Iterator[float]:
    """Growing delays before each further try."""
    delay = options.retry_min_delay
    for _ in range(options.max_retries):
        yield delay
        delay = min(2 * delay, MOST_DELAY)


def with_retries(action, options: Options, worth: Callable[[Exception], bool] = lambda e: isinstance(e, StorageError) and e.kind == RETRY):
    """The action's result; errors worth it, those of class retry, are tried again with growing delay."""
    for delay in delays(options):
        try:
            return action()
        except Exception as e:
            if not worth(e):
                raise
            time.sleep(delay)
    return action()


class Staged:
    """A file being written. Nothing is seen at its path before ``commit``; ``abort`` leaves nothing."""

    def write(self, data: bytes) -> None:
        raise NotImplementedError

    def commit(self) -> None:
        raise NotImplementedError

    def abort(self) -> None:
        raise NotImplementedError


class Store:
    """What an archive needs of a place. ``lists`` tells that listing a folder is cheaper than asking for its files one by one."""

    writable = False
    lists = False

    def __init__(self, root: str, options: Options | None = None):
        self.root, self.options = root.rstrip("/"), options or Options()

    def key(self, path: str) -> str:
        return f"{self.root}/{path.lstrip('/')}"

    def open(self, path: str, start: int = 0):
        """A readable stream of the file's bytes from ``start`` on; raises ``StorageError``."""
        raise NotImplementedError

    def size(self, path: str) -> int:
        """Bytes of the file; raises ``StorageError``, of class not_found if it is not there."""
        raise NotImplementedError

    def children(self, folder: str) -> Iterator[tuple[str, int | None]]:
        """(path, bytes) of what lies directly in a folder; folders have no bytes. A missing folder is empty."""
        raise StorageError(FATAL, f"{self.root} cannot be listed")

    def walk(self, folder: str) -> Iterator[tuple[str, int]]:
        """(path, bytes) of all files below a folder."""
        for path, size in self.children(folder):
            if size is None:
                yield from self.walk(path)
            else:
                yield path, size

    def stage(self, path: str) -> Staged:
        raise StorageError(FATAL, f"{self.root} is read-only")

    def ranges(self, path: str, pace: Callable[[int], None] | None = None, retries: bool = True) -> Iterator[bytes]:
        """The file in ranges of at most ``range_bytes``; after an error worth it, reading goes on where it ended."""
        at, left = 0, delays(self.options) if retries else iter(())
        while True:
            try:
                with self.open(path, at) as stream:
                    while True:
                        with told(path):
                            piece = stream.read(self.options.range_bytes)
                        if not piece:
                            return
                        at += len(piece)
                        if pace:
                            pace(len(piece))
                        yield piece
            except StorageError as e:
                delay = next(left, None) if e.kind == RETRY else None
                if delay is None:
                    raise
                time.sleep(delay)


# --- files -------------------------------------------------------------------


class _StagedFile(Staged):
    def __init__(self, target: str, path: str, sync: bool):
        self.target, self.path, self.sync = target, path, sync
        self.temporary = f"{target}.{uuid.uuid4().hex}.tmp"
        with told(path):
            os.makedirs(os.path.dirname(target), exist_ok=True)
            self.out = open(self.temporary, "wb")

    def write(self, data: bytes) -> None:
        with told(self.path):
            self.out.write(data)

    def commit(self) -> None:
        try:
            with told(self.path):
                if self.sync:
                    self.out.flush()
                    os.fsync(self.out.fileno())
                self.out.close()
                os.replace(self.temporary, self.target)
        except StorageError:
            self.abort()
            raise

    def abort(self) -> None:
        with contextlib.suppress(OSError):
            self.out.close()
        with contextlib.suppress(OSError):
            os.remove(self.temporary)


class FileStore(Store):
    """A folder that all executors mount."""

    writable = True

    def open(self, path: str, start: int = 0):
        with told(path):
            stream = open(self.key(path), "rb", buffering=0)
            stream.seek(start)
            return stream

    def size(self, path: str) -> int:
        with told(path):
            return os.path.getsize(self.key(path))

    def children(self, folder: str) -> Iterator[tuple[str, int | None]]:
        try:
            with told(folder):
                found = sorted(os.scandir(self.key(folder)), key=lambda e: e.name)
        except StorageError as e:
            if e.kind == NOT_FOUND:
                return
            raise
        for entry in found:
            yield f"{folder.rstrip('/')}/{entry.name}".lstrip("/"), None if entry.is_dir() else entry.stat().st_size

    def stage(self, path: str) -> Staged:
        return _StagedFile(self.key(path), path, self.options.atomic_file_writes)


# --- HTTP and Swift ----------------------------------------------------------


class _Body(io.RawIOBase):
    """A response's body; one that ends before its stated length is an error."""

    def __init__(self, response, path: str, skip: int):
        self.response, self.path = response, path
        stated = response.headers.get("Content-Length")
        self.left = None if stated is None else int(stated)
        while skip:
            skip -= len(self.read(min(skip, 1 << 20)) or self._early())

    def _early(self):
        raise StorageError(RETRY, f"{self.path}: body ends early")

    def read(self, n: int = -1) -> bytes:
        piece = self.response.read(n)
        if self.left is not None:
            self.left -= len(piece)
            if not piece and n and self.left:
                self._early()
        return piece

    def close(self) -> None:
        self.response.close()
        super().close()


class HttpStore(Store):
    """Files below a URL, read-only. Servers that know no ranges are read from the start again."""

    def headers(self) -> dict[str, str]:
        return {"User-Agent": self.options.user_agent}

    def _ask(self, path: str, method: str = "GET", **headers: str):
        request = urllib.request.Request(self.key(path), headers={**self.headers(), **headers}, method=method)
        with told(path):
            return urllib.request.urlopen(request, timeout=self.options.timeout if method == "HEAD" else self.options.io_timeout)

    def open(self, path: str, start: int = 0):
        response = self._ask(path, **({"Range": f"bytes={start}-"} if start else {}))
        with told(path):
            return _Body(response, path, 0 if response.status == 206 else start)

    def size(self, path: str) -> int:
        def ask() -> int:
            with self._ask(path, "HEAD") as response:
                return int(response.headers.get("Content-Length") or 0)

        return with_retries(ask, self.options)


class _StagedObject(Staged):
    """A chunked upload under a temporary name; the commit is a copy by the server."""

    def __init__(self, store: SwiftStore, path: str):
        self.store, self.path, self.temporary = store, path, f"{path}.{uuid.uuid4().hex}.tmp"
        parsed = urlparse(store.key(self.temporary))
        kind = http.client.HTTPSConnection if parsed.scheme == "https" else http.client.HTTPConnection
        with told(path):
            self.connection = kind(parsed.netloc, timeout=store.options.io_timeout)
            self.connection.putrequest("PUT", parsed.path)
            for k, v in {**store.headers(), "Transfer-Encoding": "chunked"}.items():
                self.connection.putheader(k, v)
            self.connection.endheaders()

    def write(self, data: bytes) -> None:
        with told(self.path):
            if data:
                self.connection.send(b"%x\r\n%b\r\n" % (len(data), data))

    def _finish(self) -> None:
        with told(self.path):
            self.connection.send(b"0\r\n\r\n")
            response = self.connection.getresponse()
            response.read()
            self.connection.close()
        if response.status >= 300:
            raise StorageError(status_class(response.status), f"{self.path}: status {response.status}")

    def commit(self) -> None:
        try:
            self._finish()
            source = urlparse(self.store.key(self.temporary)).path.removeprefix(urlparse(self.store.endpoint).path)
            self.store._ask(self.path, "PUT", **{"X-Copy-From": source, "Content-Length": "0"}).close()
        finally:
            self.abort()

    def abort(self) -> None:
        self.connection.close()
        with contextlib.suppress(StorageError):
            self.store._ask(self.temporary, "DELETE").close()


class SwiftStore(HttpStore):
    """A container of OpenStack's object store, by its HTTP interface."""

    writable = lists = True

    def __init__(self, endpoint: str, container: str, prefix: str, token: str | None, options: Options | None = None):
        super().__init__("/".join(x for x in (endpoint.rstrip("/"), quote(container), quote(prefix.strip("/"))) if x), options)
        self.endpoint, self.container, self.prefix, self.token = endpoint.rstrip("/"), container, prefix.strip("/"), token

    def headers(self) -> dict[str, str]:
        return {**super().headers(), **({"X-Auth-Token": self.token} if self.token else {})}

    def children(self, folder: str) -> Iterator[tuple[str, int | None]]:
        below = f"{self.prefix}/" if self.prefix else ""
        prefix, marker = f"{below}{folder.strip('/')}/", ""
        while True:
            asked = f"{self.endpoint}/{quote(self.container)}?format=json&delimiter=/&limit=10000&prefix={quote(prefix)}&marker={quote(marker)}"
            with told(folder), urllib.request.urlopen(urllib.request.Request(asked, headers=self.headers()), timeout=self.options.io_timeout) as response:
                found = json.loads(response.read() or b"[]")
            if not found:
                return
            for entry in found:
                name = entry.get("name") or entry["subdir"]
                yield name.removeprefix(below).rstrip("/"), entry.get("bytes") if "name" in entry else None
            marker = name

    def stage(self, path: str) -> Staged:
        return _StagedObject(self, path)


# --- Arrow's filesystems -----------------------------------------------------


@lru_cache(maxsize=64)
def _filesystem(scheme: str, host: str, settings: tuple[tuple[str, str], ...]):
    from pyarrow import fs

    given = dict(settings)
    if scheme == "s3a":
        return fs.S3FileSystem(**given)
    if scheme == "gs":
        return fs.GcsFileSystem(**given)
    if scheme in ("abfss", "wasbs"):
        return fs.AzureFileSystem(**given)
    if scheme in ("hdfs", "viewfs"):
        return fs.HadoopFileSystem.from_uri(f"{scheme}://{host}/")
    if scheme == "file":
        return fs.LocalFileSystem()
    raise StorageError(FATAL, f"unknown scheme: {scheme}")


class _StagedArrow(Staged):
    def __init__(self, store: ArrowStore, path: str):
        self.store, self.path, self.target = store, path, store.at(path)
        self.temporary = f"{self.target}.{uuid.uuid4().hex}.tmp"
        with told(path):
            if store.scheme in ("file", "hdfs", "viewfs"):
                store.fs.create_dir(self.target.rsplit("/", 1)[0], recursive=True)
            self.out = store.fs.open_output_stream(self.temporary)

    def write(self, data: bytes) -> None:
        with told(self.path):
            self.out.write(data)

    def commit(self) -> None:
        try:
            with told(self.path):
                self.out.close()
                if self.store.scheme in ("hdfs", "viewfs"):  # whose rename replaces nothing
                    with contextlib.suppress(FileNotFoundError):
                        self.store.fs.delete_file(self.target)
                self.store.fs.move(self.temporary, self.target)
        except StorageError:
            self.abort()
            raise

    def abort(self) -> None:
        with contextlib.suppress(OSError):
            self.out.close()
        with contextlib.suppress(OSError):
            self.store.fs.delete_file(self.temporary)


class ArrowStore(Store):
    """A folder of an object store or of Hadoop's; every process makes its own client from the settings."""

    writable = lists = True

    def __init__(self, scheme: str, root: str, settings: Mapping[str, str] | None = None, options: Options | None = None):
        super().__init__(root, options)
        self.scheme, self.settings = scheme, tuple(sorted((settings or {}).items()))
        parsed = urlparse(root)
        self.host = parsed.netloc
        # the container of abfss://container@account is all of the host that belongs to a path
        bucket = parsed.netloc.split("@")[0]
        self.base = (parsed.path if scheme in ("file", "hdfs", "viewfs") else f"{bucket}{parsed.path}").rstrip("/")

    @property
    def fs(self):
        return _filesystem(self.scheme, self.host, self.settings)

    def at(self, path: str) -> str:
        return f"{self.base}/{path.strip('/')}"

    def open(self, path: str, start: int = 0):
        with told(path):
            stream = self.fs.open_input_file(self.at(path))
            stream.seek(start)
            return stream

    def size(self, path: str) -> int:
        with told(path):
            info = self.fs.get_file_info(self.at(path))
        if not info.is_file:
            raise StorageError(NOT_FOUND, f"{path}: not found")
        return info.size

    def _below(self, folder: str, recursive: bool):
        from pyarrow import fs

        with told(folder):
            return self.fs.get_file_info(fs.FileSelector(self.at(folder), allow_not_found=True, recursive=recursive))

    def children(self, folder: str) -> Iterator[tuple[str, int | None]]:
        for info in self._below(folder, False):
            yield info.path[len(self.base) :].strip("/"), info.size if info.is_file else None

    def walk(self, folder: str) -> Iterator[tuple[str, int]]:
        for info in self._below(folder, True):
            if info.is_file:
                yield info.path[len(self.base) :].strip("/"), info.size

    def stage(self, path: str) -> Staged:
        return _StagedArrow(self, path)


# --- SFTP --------------------------------------------------------------------


class _StagedRemote(Staged):
    def __init__(self, store: SftpStore, path: str):
        self.client, self.path, self.target = store.client(), path, store.key(path)
        self.temporary = f"{self.target}.{uuid.uuid4().hex}.tmp"
        with told(path):
            parts = self.target.split("/")
            for k in range(2, len(parts)):
                with contextlib.suppress(OSError):
                    self.client.mkdir("/".join(parts[:k]))
            self.out = self.client.open(self.temporary, "wb")

    def write(self, data: bytes) -> None:
        with told(self.path):
            self.out.write(data)

    def commit(self) -> None:
        try:
            with told(self.path):
                self.out.close()
                self.client.posix_rename(self.temporary, self.target)
        except StorageError:
            self.abort()
            raise

    def abort(self) -> None:
        with contextlib.suppress(OSError):
            self.out.close()
        with contextlib.suppress(OSError):
            self.client.remove(self.temporary)


def _sftp_client(host: str, port: int, user: str | None, key: str | None):
    import paramiko

    client = paramiko.SSHClient()
    client.load_system_host_keys()
    client.connect(host, port=port, username=user, key_filename=key)
    return client.open_sftp()


class SftpStore(Store):
    """A folder of an SSH server. ``connect(host, port, user, key)`` gives a client with the calls of paramiko's SFTPClient."""

    writable = True

    def __init__(self, url: str, user: str | None = None, key: str | None = None, options: Options | None = None, connect: Callable = _sftp_client):
        parsed = urlparse(url)
        super().__init__(unquote(parsed.path), options)
        self.address = (parsed.hostname, parsed.port or 22, user or parsed.username, key)
        self.connect, self._client = connect, None

    def __getstate__(self):
        return {**self.__dict__, "_client": None}

    def client(self):
        if self._client is None:
            with told(self.root):
                self._client = self.connect(*self.address)
        return self._client

    def open(self, path: str, start: int = 0):
        with told(path):
            stream = self.client().open(self.key(path), "rb")
            stream.seek(start)
            return stream

    def size(self, path: str) -> int:
        with told(path):
            return self.client().stat(self.key(path)).st_size

    def children(self, folder: str) -> Iterator[tuple[str, int | None]]:
        try:
            with told(folder):
                found = self.client().listdir_attr(self.key(folder))
        except StorageError as e:
            if e.kind == NOT_FOUND:
                return
            raise
        for entry in sorted(found, key=lambda e: e.filename):
            is_folder = (entry.st_mode or 0) & 0o170000 == 0o040000
            yield f"{folder.rstrip('/')}/{entry.filename}".lstrip("/"), None if is_folder else entry.st_size

    def stage(self, path: str) -> Staged:
        return _StagedRemote(self, path)


# --- the registry ------------------------------------------------------------

HADOOP_SCHEMES = {"s3": "s3a", "s3a": "s3a", "b2": "s3a", "gs": "gs", "gcs": "gs", "azblob": "abfss", "azure": "abfss", "abfss": "abfss", "wasbs": "wasbs", "hdfs": "hdfs", "viewfs": "viewfs"}


def object_settings(scheme: str, environ: Mapping[str, str] = os.environ) -> dict[str, str]:
    """Arguments of Arrow's filesystem for a URL's scheme, from the usual environment variables of the driver."""
    get = environ.get
    out: dict[str, str | None] = {}
    if scheme in ("s3", "s3a"):
        out = {"region": get("AWS_REGION"), "access_key": get("AWS_ACCESS_KEY_ID"), "secret_key": get("AWS_SECRET_ACCESS_KEY"), "session_token": get("AWS_SESSION_TOKEN")}
    elif scheme == "b2":
        missing = [k for k in ("B2_BUCKET_ID", "B2_APPLICATION_KEY_ID", "B2_APPLICATION_KEY") if not get(k)]
        if missing:
            raise StorageError(FATAL, f"b2 needs {', '.join(missing)}")
        out = {"region": get("AWS_REGION"), "access_key": get("B2_APPLICATION_KEY_ID"), "secret_key": get("B2_APPLICATION_KEY")}
    elif scheme in ("azblob", "azure", "abfss", "wasbs"):
        out = {"account_name": get("AZURE_STORAGE_ACCOUNT"), "account_key": get("AZURE_STORAGE_KEY")}
    if scheme in ("s3", "s3a", "b2") and (endpoint := get("S3_ENDPOINT")):
        parsed = urlparse(endpoint if "://" in endpoint else f"https://{endpoint}")
        out |= {"endpoint_override": parsed.netloc, "scheme": parsed.scheme}
    return {k: v for k, v in out.items() if v}


def _arrow(scheme: str) -> Callable[[str, Options], Store]:
    return lambda url, options: ArrowStore(HADOOP_SCHEMES[scheme], url, object_settings(scheme), options)


def _swift(url: str, options: Options) -> Store:
    endpoint = os.environ.get("SWIFT_ENDPOINT")
    if not endpoint:
        raise StorageError(FATAL, "swift needs SWIFT_ENDPOINT, the URL of the account")
    parsed = urlparse(url)
    return SwiftStore(endpoint, parsed.netloc, parsed.path, os.environ.get("SWIFT_TOKEN"), options)


def _sftp(url: str, options: Options) -> Store:
    if importlib.util.find_spec("paramiko") is None:
        raise StorageError(FATAL, "sftp needs the package paramiko on driver and executors")
    return SftpStore(url, os.environ.get("SFTP_USER"), os.environ.get("SFTP_KEY"), options)


STORES: dict[str, Callable[[str, Options], Store]] = {
    "file": lambda url, options: FileStore(url, options),
    "http": lambda url, options: HttpStore(url, options),
    "https": lambda url, options: HttpStore(url, options),
    "swift": _swift,
    "sftp": _sftp,
    **{scheme: _arrow(scheme) for scheme in HADOOP_SCHEMES},
}


def by_value(code: object) -> None:
    """Let tasks have the code of a class or function that they cannot import: its module goes along with it."""
    from pyspark import cloudpickle

    module = sys.modules.get(getattr(code, "__module__", ""))
    if module is not None and module.__name__ != "__main__" and not module.__name__.startswith("ledgerloom."):
        cloudpickle.register_pickle_by_value(module)


def register(scheme: str, factory: Callable[[str, Options], Store]) -> None:
    """Let ``archive`` know URLs of a further scheme; ``factory(url, options)`` gives their store."""
    by_value(factory)
    STORES[scheme.lower()] = factory
