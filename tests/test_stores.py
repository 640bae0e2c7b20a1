"""Stores and archives on them: ranges, staging, listing, object stores, and what others add."""

import gzip
import hashlib
import http.server
import json
import os
import shutil
import threading
import time
import tracemalloc
import zlib
from dataclasses import dataclass
from urllib.parse import parse_qs, unquote, urlparse

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.bounds import archive_bounds
from ledgerloom.plans import operations as ops
from ledgerloom.sources import storage, stores
from ledgerloom.sources.decode import decode_file, decoded
from ledgerloom.sources.storage import Archive, Options, StorageError, archive

from . import archives as a
from .object_store import Store as Objects
from .object_store import handler, served

SMALL = Options(max_retries=2, retry_min_delay=0.01, range_bytes=100)
QUICK = Options(max_retries=2, retry_min_delay=0.01, range_bytes=8192)


@pytest.fixture(scope="module")
def good(tmp_path_factory):
    root = tmp_path_factory.mktemp("good")
    a.build(root)
    return root


class Memory(stores.Store):
    """A store that is a dict of the module, for what needs no other process."""

    writable = lists = True

    def __init__(self, files, options=SMALL):
        super().__init__("memory://x", options)
        self.files = files

    def open(self, path, start=0):
        import io

        if path not in self.files:
            raise StorageError("not_found", path)
        return io.BytesIO(self.files[path][start:])

    def stage(self, path):
        store = self

        class Staged(stores.Staged):
            data = b""

            def write(self, data):
                self.data += data

            def commit(self):
                store.files[path] = self.data

            def abort(self):
                store.files[f"{path} aborted"] = b""

        return Staged()


def bucket(raw):
    return a.bucket_path(hashlib.sha256(raw).hexdigest())


def test_ranges_end_where_files_do(tmp_path):
    for n in (0, 1, 99, 100, 101, 250):
        (tmp_path / "x").write_bytes(bytes(n))
        found = list(stores.FileStore(str(tmp_path), SMALL).ranges("x"))
        assert sum(map(len, found)) == n and all(len(p) == 100 for p in found[:-1]) and len(found) == -(-n // 100)


def test_a_file_is_checked_and_copied_in_ranges():
    raw = os.urandom(5000)
    path = bucket(raw)
    source, target = Memory({path: gzip.compress(raw)}), Memory({})
    rows, spent = decode_file(source, "bucket", 63, path, target)
    assert rows == [] and target.files == source.files and spent["bytes_out"] == 5000 and spent["bytes_in"] == len(source.files[path])


@pytest.mark.parametrize("damage", ["content", "cut", "garbage", "trailing"])
def test_what_does_not_hold_is_not_committed(damage):
    raw = os.urandom(5000)
    whole = gzip.compress(raw)
    path = bucket(raw)
    data = {"content": gzip.compress(raw + b"x"), "cut": whole[:-20], "garbage": b"g" * 500, "trailing": whole + b"more" * 100}[damage]
    source, target = Memory({path: data}), Memory({path: b"older"})
    if damage == "trailing":  # one member counts; the copy is whole
        decode_file(source, "bucket", 63, path, target)
        assert target.files[path] == data
        return
    with pytest.raises(StorageError) as e:
        decode_file(source, "bucket", 63, path, target)
    assert e.value.kind == ("fatal" if damage == "content" else "retry")
    assert target.files[path] == b"older" and f"{path} aborted" in target.files


def test_a_long_bucket_needs_no_memory():
    """300 MB of content, 256 KB at a time: what is held stays far below either."""
    n, block = 300, bytes(1 << 20)
    h, z = hashlib.sha256(), zlib.compressobj(1, zlib.DEFLATED, 31)
    packed = []
    for k in range(n):
        some = k.to_bytes(4, "big") + block[4:]
        h.update(some)
        packed.append(z.compress(some))
    packed.append(z.flush())
    path = a.bucket_path(h.hexdigest())

    class Long(stores.Store):
        def ranges(self, path, pace=None, retries=True):
            yield from (p for p in packed if p)

    tracemalloc.start()
    try:
        _, spent = decode_file(Long("x", Options(max_retries=0)), "bucket", 63, path)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert spent["bytes_out"] == n << 20 and peak < 8 << 20


def test_reading_goes_on_where_it_ended():
    """A connection that ends early is resumed from the byte it ended at, by servers that know ranges and by others."""
    data, asked = os.urandom(1000), []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            start = int((self.headers.get("Range") or "bytes=0-")[6:-1])
            asked.append(start)
            start = start if "ranged" in self.path else 0
            self.send_response(206 if start else 200)
            self.send_header("Content-Length", str(len(data) - start))
            self.end_headers()
            self.wfile.write(data[start:] if len(asked) > 2 else data[start : start + 250])

        def log_message(self, *args):
            pass

    with served(Handler) as port:
        for name in ("ranged", "whole"):
            asked.clear()
            assert b"".join(stores.HttpStore(f"http://127.0.0.1:{port}", SMALL).ranges(name)) == data
            assert len(asked) == 3 and asked[1] >= 200 and asked[2] >= asked[1]
            asked.clear()
            with pytest.raises(StorageError):
                b"".join(stores.HttpStore(f"http://127.0.0.1:{port}", SMALL).ranges(name, retries=False))


def test_a_failing_task_leaves_nothing(spark, good, tmp_path):
    target = tmp_path / "t"
    shutil.copytree(good, tmp_path / "s")
    for kind in ("ledger", "results"):
        (tmp_path / "s" / a.file_path(kind, 127)).write_bytes(gzip.compress(b"wrong"))
    for scheme in ("file", "hadoop"):
        goal = Archive("file", str(target), QUICK) if scheme == "file" else Archive("hadoop", f"file:{target}", QUICK)
        with pytest.raises(ops.OperationFailed):
            ops.mirror(spark, archive(f"file://{tmp_path / 's'}", QUICK), goal, verify=True, overwrite=True, root_pointer="root-history.json")
        found = a.tree(target)
        assert not [p for p in found if p.endswith(".tmp")] and a.file_path("ledger", 127) not in found and a.file_path("scp", 127) in found
        shutil.rmtree(target)


def test_mirror_to_hadoop_path(spark, good, tmp_path):
    """Both sides by Arrow's filesystems, on local files."""
    source, target = (Archive("hadoop", f"file:{p}", QUICK) for p in (good, tmp_path / "t"))
    ops.mirror(spark, source, target, verify=True, root_pointer="root-history.json")
    assert a.tree(tmp_path / "t") == a.tree(good)
    (tmp_path / "t" / a.file_path("ledger", 127)).unlink()
    ops.repair(spark, source, target, verify=True, root_pointer="root-history.json")
    assert a.tree(tmp_path / "t") == a.tree(good)


@pytest.fixture
def s3(monkeypatch, good):
    store = Objects()
    with served(handler(store)) as port:
        for k, v in {"AWS_REGION": "us-east-1", "AWS_ACCESS_KEY_ID": "k", "AWS_SECRET_ACCESS_KEY": "s", "S3_ENDPOINT": f"http://127.0.0.1:{port}"}.items():
            monkeypatch.setenv(k, v)
        store.objects.update({f"source/{p}": data for p, data in a.tree(good).items()})
        yield store


def of(store, prefix):
    return {k.removeprefix(prefix): v for k, v in store.objects.items() if k.startswith(prefix) and not k.endswith("/")}


def test_object_store(spark, s3, good, tmp_path):
    source, target = archive("s3://box/source", QUICK), archive("s3://box/target", QUICK)
    assert ops.scan(spark, source, verify=True, root_pointer="root-history.json").report["summary"]["succeeded"] == 19
    ops.mirror(spark, source, archive(f"file://{tmp_path / 't'}", QUICK), verify=True, root_pointer="root-history.json")
    assert a.tree(tmp_path / "t") == a.tree(good)
    ops.mirror(spark, archive(f"file://{good}", QUICK), target, verify=True)
    assert of(s3, "target/") == a.tree(good)
    # what is missing, and what is refused, is told apart
    del s3.objects[f"target/{a.file_path('ledger', 127)}"]
    with pytest.raises(ops.OperationFailed) as e:
        ops.scan(spark, target, root_pointer="root-history.json")
    assert e.value.result.report["files"] == {"127": ["ledger"]} and e.value.result.report["summary"]["failed"] == 1
    ops.repair(spark, source, target, verify=True, root_pointer="root-history.json")
    assert of(s3, "target/") == a.tree(good)
    s3.refused.add("source/secret")
    rows = source.present(spark.createDataFrame([("secret",), ("gone",)], "path string")).collect()
    assert {(r.path, r.error_class) for r in rows} == {("secret", "fatal"), ("gone", "not_found")}


def test_folders_with_many_files_are_listed_once(spark, s3, good):
    source = archive("s3://box/many", QUICK)
    s3.objects.update({f"many/ledger/00/00/{k:02x}/ledger-{k}.xdr.gz": b"x" for k in range(40)} | {"many/ledger/00/00/00/empty": b""})
    asked = [(f"ledger/00/00/{k:02x}/ledger-{k}.xdr.gz", k) for k in range(60)] + [("ledger/00/00/00/empty", -1), ("scp/00/00/00/one", -2)]
    s3.asked.clear()
    rows = source.present(spark.createDataFrame(asked, "path string, k long")).collect()
    assert {r.k for r in rows if r.present} == set(range(40)) and len(rows) == 62
    assert all(r.error_class == (None if r.present else "not_found") for r in rows)
    assert len([1 for method, _ in s3.asked if method in ("HEAD", "GET")]) <= 6


@pytest.mark.parametrize("kind", ["file", "hadoop", "s3"])
def test_listing_by_tasks(spark, good, s3, kind):
    source = {"file": Archive("file", str(good)), "hadoop": Archive("hadoop", f"file:{good}"), "s3": archive("s3://box/source")}[kind]
    found = {(r.path, r.length) for r in source.listing(spark, ["ledger", "bucket", "none"]).collect()}
    assert found == {(p, len(d)) for p, d in a.tree(good).items() if p.startswith(("ledger/", "bucket/"))}


def test_no_path_passes_the_driver(spark, tmp_path):
    """20,000 expected files: presence and content come from a range of numbers, and the driver gets counts."""
    for scheme in ("file", "hadoop"):
        where = Archive("file", str(tmp_path)) if scheme == "file" else Archive("hadoop", f"file:{tmp_path}")
        asked = ops.checkpoint_files(spark.range(63, 64 * 5_000 + 63, 64).select(F.col("id").alias("cp")), False)
        plans = []
        for df in (where.present(asked), decoded(asked, where), where.contents(asked)):
            assert df.groupBy("error_class").count().collect() == [("not_found", 20_000)]
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        assert all("LocalTableScan" not in p and "Union" not in p and "FileScan" not in p for p in plans)


def test_one_limit_for_all_tasks(spark, tmp_path):
    """Eight files of 40 KB at 200 KB a second take 1.6 s, however many tasks run."""
    for k in range(8):
        (tmp_path / f"bucket-{k}").write_bytes(os.urandom(40_000))
    asked = spark.createDataFrame([(f"bucket-{k}", "bucket", 63) for k in range(8)], "path string, kind string, cp bigint").repartition(8)
    for limit, least in ((200_000, 1.5), (0, 0)):
        source = Archive("file", str(tmp_path), Options(bandwidth_limit=limit, range_bytes=4096, max_retries=0))
        df = decoded(asked, source, Archive("file", str(tmp_path / "t")), verify=False)
        began = time.monotonic()
        assert df.where("parsed").count() == 8
        assert time.monotonic() - began >= least
        assert df.rdd.getNumPartitions() == (spark.sparkContext.defaultParallelism if limit else 8)


class Swift(http.server.BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"
    objects: dict = {}

    def log_message(self, *args):
        pass

    def answer(self, status, data=b""):
        self.send_response(status)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        if self.command != "HEAD":
            self.wfile.write(data)

    def do_any(self):
        parsed = urlparse(self.path)
        key = unquote(parsed.path).removeprefix("/v1/me")
        if self.headers.get("X-Auth-Token") != "token":
            self.answer(401)
        elif self.command == "GET" and key == "/box":
            query = {k: v[0] for k, v in parse_qs(parsed.query).items()}
            names, prefix = [], query.get("prefix", "")
            for name in sorted(k.removeprefix("/box/") for k in self.objects):
                if name.startswith(prefix):
                    head, cut, _ = name[len(prefix) :].partition("/")
                    names.append(prefix + head + cut)
            some = [n for n in sorted(set(names)) if n > query.get("marker", "")][:2]
            self.answer(200, json.dumps([{"subdir": n} if n.endswith("/") else {"name": n, "bytes": len(self.objects[f"/box/{n}"])} for n in some]).encode())
        elif self.command == "PUT":
            if source := self.headers.get("X-Copy-From"):
                data = self.objects[unquote(source)]
            else:
                data = b""
                while size := int(self.rfile.readline(), 16):
                    data += self.rfile.read(size)
                    self.rfile.readline()
                self.rfile.readline()
            self.objects[key] = data
            self.answer(201)
        elif key not in self.objects:
            self.answer(404)
        elif self.command == "DELETE":
            del self.objects[key]
            self.answer(204)
        else:
            self.answer(200, self.objects[key])

    do_GET = do_HEAD = do_PUT = do_DELETE = do_any


def test_swift(spark, good, tmp_path, monkeypatch):
    Swift.objects = {}
    with served(Swift) as port:
        monkeypatch.setenv("SWIFT_ENDPOINT", f"http://127.0.0.1:{port}/v1/me")
        monkeypatch.setenv("SWIFT_TOKEN", "token")
        there = archive("swift://box/deep/archive", QUICK)
        ops.mirror(spark, archive(f"file://{good}", QUICK), there, verify=True)
        assert {k.removeprefix("/box/deep/archive/"): v for k, v in Swift.objects.items()} == a.tree(good)
        assert ops.scan(spark, there, verify=True, root_pointer="root-history.json").report["summary"]["succeeded"] == 19
        assert ops.scan(spark, there, root_pointer="root-history.json").report["summary"]["succeeded"] == 19
        assert {r.path for r in there.listing(spark, ["bucket"]).collect()} == {p for p in a.tree(good) if p.startswith("bucket/")}
        monkeypatch.setenv("SWIFT_TOKEN", "wrong")
        with pytest.raises(StorageError) as e:
            archive("swift://box/deep/archive", QUICK).read(".well-known/root-history.json")
        assert e.value.kind == "fatal"


class Remote:
    """The calls of an SFTP client, on local files."""

    def __init__(self, *address):
        self.address = address

    open = staticmethod(open)
    stat = staticmethod(os.stat)
    mkdir = staticmethod(os.mkdir)
    remove = staticmethod(os.remove)
    posix_rename = staticmethod(os.replace)

    def listdir_attr(self, path):
        from types import SimpleNamespace

        return [SimpleNamespace(filename=e.name, st_mode=e.stat().st_mode, st_size=e.stat().st_size) for e in os.scandir(path)]


def test_sftp(spark, good, tmp_path):
    stores.by_value(Remote)
    there = Archive("sftp", "sftp://host/", QUICK, stores.SftpStore(f"sftp://me@host:2222{tmp_path}/t", options=QUICK, connect=Remote))
    assert there.store.address == ("host", 2222, "me", None)
    ops.mirror(spark, archive(f"file://{good}", QUICK), there, verify=True)
    assert a.tree(tmp_path / "t") == a.tree(good)
    assert ops.scan(spark, there, verify=True, root_pointer="root-history.json").report["summary"]["succeeded"] == 19
    assert {r.path for r in there.listing(spark, ["scp"]).collect()} == {p for p in a.tree(good) if p.startswith("scp/")}
    assert there.store.connect is Remote and not list(tmp_path.rglob("*.tmp"))


class Shifted(stores.FileStore):
    """A store of one's own: files lie under turned names."""

    def key(self, path):
        return f"{self.root}/{path[::-1].replace('/', '_')}"


@dataclass
class Sizes(ops.Operation):
    """An operation of one's own: files of an odd number of bytes fail."""

    archive: object
    name = "sizes"
    ended = False

    def bounds(self, spark):
        return archive_bounds(ops.read_pointer(spark, self.archive, ".well-known/root-history.json"), None, None)

    def histories(self, files):
        return ops.Scan(self.archive).histories(files)

    def objects(self, files):
        read = decoded(files, self.archive, verify=False)
        odd = F.col("bytes_in") % 2 == 1
        return read.select("path", "kind", "cp", F.when(odd, "failed").otherwise("processed").alias("outcome"), F.when(odd, "fatal").alias("error_class"), F.when(odd, "odd").alias("error")), None

    def finalize(self, b, result):
        self.ended = (b.low, b.high, result.failed)


def test_stores_and_operations_of_others(spark, good, tmp_path):
    stores.register("turned", lambda url, options: Shifted(url.removeprefix("turned://"), options))
    (tmp_path / "x").mkdir()
    for p, data in a.tree(good).items():
        (tmp_path / "x" / p[::-1].replace("/", "_")).write_bytes(data)
    there = archive(f"turned://{tmp_path}/x", QUICK)
    assert ops.scan(spark, there, verify=True, root_pointer="root-history.json").report["summary"]["succeeded"] == 19
    mine = Sizes(there)
    found = ops.run(spark, mine)
    odd = [p for p, d in a.tree(good).items() if len(d) % 2 and not p.startswith((".well", "history"))]
    assert found.report["summary"]["failed"] == len(odd) and mine.ended == (63, 191, bool(odd))


def test_phases(spark, good, tmp_path):
    source, target = archive(f"file://{good}"), archive(f"file://{tmp_path / 't'}")
    table = ops.mirror(spark, source, target, verify=True).phases.table()
    files = a.tree(good)
    size = lambda *kinds: sum(len(d) for p, d in files.items() if p.startswith(kinds))
    calls = {p: x["calls"] for p, x in table.items()}
    assert calls == {"history_fetch": 3, "history_parse": 3, "bucket_stream": 4, "xdr_decompress": 12, "xdr_parse_ledger": 3, "xdr_parse_tx": 3, "xdr_parse_result": 3, "xdr_parse_scp": 3, "cross_file_verify": 1, "chain_verify": 1, "copy": 16}
    assert table["history_fetch"]["bytes"] == size("history/") and table["bucket_stream"]["bytes"] == size("bucket/")
    assert table["copy"]["bytes"] == size("bucket/", "ledger/", "transactions/", "results/", "scp/")
    assert table["xdr_parse_ledger"]["bytes"] == sum(len(gzip.decompress(d)) for p, d in files.items() if p.startswith("ledger/"))
    assert all(x["seconds"] > 0 for x in table.values())
    plain = ops.scan(spark, source).phases
    assert {p for p, x in plain.table().items() if x["calls"]} == {"history_fetch", "history_parse"}
    assert plain.table() == plain.table() and len(plain.lines()) == 12


def test_values_have_a_bound(good, monkeypatch):
    monkeypatch.setattr(storage, "MOST_VALUE", 10)
    with pytest.raises(StorageError):
        archive(f"file://{good}", QUICK).read(a.file_path("history", 63))


def test_threads_share_no_client(tmp_path):
    (tmp_path / "x").write_bytes(b"1")
    there, found = stores.ArrowStore("file", f"file:{tmp_path}"), []
    some = [threading.Thread(target=lambda: found.append(there.size("x"))) for _ in range(4)]
    [t.start() for t in some]
    [t.join() for t in some]
    assert found == [1] * 4
