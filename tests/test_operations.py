import gzip
import http.server
import json
import shutil
import threading
from pathlib import Path

import pytest

from ledgerloom.operators import report as reports
from ledgerloom.plans import operations as ops
from ledgerloom.sources import xdr
from ledgerloom.sources.storage import Options, StorageError, archive, hadoop_settings

from . import archives as a

QUICK = Options(max_retries=2, retry_min_delay=0.01)


@pytest.fixture(scope="module")
def good(tmp_path_factory):
    root = tmp_path_factory.mktemp("good")
    a.build(root)
    return root


@pytest.fixture
def copy(good, tmp_path):
    shutil.copytree(good, tmp_path / "copy")
    return tmp_path / "copy"


def at(root):
    return archive(f"file://{root}", QUICK)


def failing_scan(spark, root, **kw):
    with pytest.raises(ops.OperationFailed) as e:
        ops.scan(spark, at(root), **kw)
    return e.value.result.report


def test_scan_good(spark, good, tmp_path):
    for verify in (False, True):
        r = ops.scan(spark, at(good), verify=verify, report_path=str(tmp_path / "r.json"))
        # 3 checkpoints of 5 files, and 4 buckets of which one is shared
        assert r.report["summary"] == {"succeeded": 19, "skipped": 0, "failed": 0, "retries": 0}
    assert reports.read(str(tmp_path / "r.json")) == r.report
    assert ops.scan(spark, at(good), low=64, high=100, skip_optional=True).report["summary"]["succeeded"] == 11


def test_scan_missing_and_empty(spark, copy):
    (copy / a.file_path("ledger", 127)).unlink()
    (copy / a.file_path("scp", 191)).write_bytes(b"")
    (copy / a.file_path("history", 63)).write_text("no json")
    found = failing_scan(spark, copy)
    assert found["files"] == {"127": ["ledger"], "191": ["scp"], "63": ["history"]}
    # the broken history hides the bucket that only it needs
    assert found["summary"]["succeeded"] == 15 and found["buckets"] == []


@pytest.mark.parametrize("kind", ["ledger", "transactions", "results", "scp"])
@pytest.mark.parametrize("damage", ["garbage", "content", "flip"])
def test_verify_finds_damage(spark, copy, kind, damage):
    path = copy / a.file_path(kind, 127)
    data = bytearray(path.read_bytes())
    if damage == "garbage":
        data = b"not gzip"
    elif damage == "content":
        data = gzip.compress(b"wrong content")
    else:
        data[20:52] = bytes(x ^ 255 for x in data[20:52])
    path.write_bytes(bytes(data))
    found = failing_scan(spark, copy, verify=True)
    assert found["files"]["127"] == [kind]
    assert ("127" in found["files"]) and (found["checkpoints"] == ([127] if kind == "ledger" else []))


def test_verify_finds_bucket(spark, copy):
    path = next(copy.rglob("bucket-*"))
    path.write_bytes(gzip.compress(b"other"))
    assert failing_scan(spark, copy, verify=True)["buckets"] == [path.name.split("-")[1].split(".")[0]]


def test_cross_file_damage(spark, tmp_path):
    wrong = b"w" * 32
    a.build(tmp_path, 3, tamper=lambda seq, tx, res: (wrong if seq == 71 else tx, wrong if seq == 140 else res))
    assert failing_scan(spark, tmp_path, verify=True)["checkpoints"] == [127, 191]


def test_boundary_damage(spark, tmp_path):
    a.build(tmp_path / "x", 3)
    a.build(tmp_path / "y", 3, tamper=lambda seq, tx, res: (b"w" * 32 if seq == 1 else tx, res))
    for kind in ("ledger", "transactions", "results"):
        shutil.copy(tmp_path / "y" / a.file_path(kind, 191), tmp_path / "x" / a.file_path(kind, 191))
    assert failing_scan(spark, tmp_path / "x", verify=True)["checkpoints"] == [127, 191]


def test_empty_ledger_file_is_parsed(spark, copy):
    (copy / a.file_path("ledger", 127)).write_bytes(gzip.compress(b""))
    found = failing_scan(spark, copy, verify=True)
    assert found["checkpoints"] == [127] and found["files"] == {}


def test_mirror_and_resume(spark, good, tmp_path):
    target = tmp_path / "target"
    ops.mirror(spark, at(good), at(target), high=127, verify=True)
    assert not (target / a.file_path("ledger", 191)).exists()
    assert json.loads((target / ".well-known/root-history.json").read_text())["currentLedger"] == 127
    r = ops.mirror(spark, at(good), at(target))
    assert r.report["summary"]["succeeded"] == 6 and r.report["summary"]["skipped"] == 1
    assert a.tree(target) == a.tree(good)
    assert ops.mirror(spark, at(good), at(target)).report["summary"]["succeeded"] == 0
    assert ops.mirror(spark, at(good), at(target), overwrite=True).report["summary"]["succeeded"] == 19


def test_mirror_of_damage_keeps_pointer(spark, copy, tmp_path):
    (copy / a.file_path("ledger", 127)).write_bytes(gzip.compress(b"wrong content"))
    with pytest.raises(ops.OperationFailed):
        ops.mirror(spark, at(copy), at(tmp_path / "t"), verify=True)
    assert not (tmp_path / "t/.well-known").exists() and not (tmp_path / "t" / a.file_path("ledger", 127)).exists()
    assert (tmp_path / "t" / a.file_path("results", 127)).exists()


def test_repair(spark, good, copy, tmp_path):
    (copy / a.file_path("ledger", 127)).write_bytes(gzip.compress(b"wrong content"))
    (copy / a.file_path("history", 63)).unlink()
    for b in list(copy.rglob("bucket-*"))[:2]:
        b.unlink()
    (copy / ".well-known/root-history.json").write_text("{}")
    before = a.tree(copy)
    plan = str(tmp_path / "plan.json")
    dry = ops.repair(spark, at(good), at(copy), verify=True, dry_run=True, report_path=plan)["main_pass"]
    assert a.tree(copy) == before and dry.report["well_known"] == 191 and dry.report["files"]["127"] == ["ledger"]
    shutil.copytree(copy, tmp_path / "second")
    stages = ops.repair(spark, at(good), at(copy), verify=True, report_path=str(tmp_path / "r.json"))
    assert list(reports.read(str(tmp_path / "r.json"))["sections"]) == ["main_pass", "file_retry", "checkpoint_retry"]
    assert stages["main_pass"].section()["summary"]["failed"] == 0
    assert a.tree(copy) == a.tree(good)
    ops.repair(spark, at(good), at(tmp_path / "second"), verify=True, plan=plan)
    assert a.tree(tmp_path / "second") == a.tree(good)
    with pytest.raises(reports.InvalidPlan):
        ops.repair(spark, at(good), at(copy), plan=str(tmp_path / "r.json"))


def test_repair_of_chain(spark, good, tmp_path):
    a.build(tmp_path / "t", 3, tamper=lambda seq, tx, res: (b"w" * 32 if seq == 71 else tx, res))
    stages = ops.repair(spark, at(good), at(tmp_path / "t"), verify=True)
    assert stages["main_pass"].section()["checkpoints"] == [127] and not stages["checkpoint_retry"].failed
    assert ops.scan(spark, at(good), verify=True)


def test_unfixable_file_does_not_stop_the_rest(spark, good, copy, tmp_path):
    (copy / a.file_path("ledger", 127)).unlink()
    shutil.copytree(good, tmp_path / "t")
    for cp in (127, 191):
        (tmp_path / "t" / a.file_path("ledger", cp)).unlink()
    with pytest.raises(ops.OperationFailed):
        ops.repair(spark, at(copy), at(tmp_path / "t"))
    assert (tmp_path / "t" / a.file_path("ledger", 191)).exists()


def test_http_with_failures(spark, good, tmp_path):
    failed = set()

    class Handler(http.server.SimpleHTTPRequestHandler):
        def __init__(self, *args, **kw):
            super().__init__(*args, directory=str(good), **kw)

        def do_GET(self):
            if self.path.endswith("ledger-0000007f.xdr.gz") and self.path not in failed:
                failed.add(self.path)
                self.send_error(503)
            else:
                super().do_GET()

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        source = archive(f"http://127.0.0.1:{server.server_port}/", QUICK)
        assert ops.scan(spark, source, root_pointer="root-history.json").report["summary"]["succeeded"] == 19
        ops.mirror(spark, source, at(tmp_path / "t"), verify=True, root_pointer="root-history.json")
        assert a.tree(tmp_path / "t") == a.tree(good) and failed
    finally:
        server.shutdown()


def test_storage_errors():
    for url in ("ftp://x", "sftp://x/y", "swift://x", "nothing"):
        with pytest.raises(StorageError):
            archive(url)
    assert archive("s3://bucket/x/").root == "s3a://bucket/x"
    assert not archive("https://host/x").writable


def test_backend_settings(monkeypatch):
    env = {"AWS_REGION": "r", "AWS_ACCESS_KEY_ID": "k", "AWS_SECRET_ACCESS_KEY": "s"}
    assert hadoop_settings("s3", env) == {"fs.s3a.endpoint.region": "r", "fs.s3a.access.key": "k", "fs.s3a.secret.key": "s"}
    with pytest.raises(StorageError):
        hadoop_settings("b2", {})
    monkeypatch.setenv("AZURE_STORAGE_ACCOUNT", "me")
    assert archive("azblob://box/a").root == "abfss://box@me.dfs.core.windows.net/a"


def test_command_line(good, copy, spark, tmp_path, capsys):
    from ledgerloom import cli

    report = str(tmp_path / "r.json")
    assert cli.main(["scan", f"file://{good}", "--verify", "--report", report, "-c", "4"]) == 0
    assert reports.read(report)["summary"]["failed"] == 0
    (copy / a.file_path("ledger", 127)).unlink()
    assert cli.main(["scan", f"file://{copy}", "-c", "4", "--report", report]) == 1
    assert cli.main(["repair", f"file://{good}", f"file://{copy}", "--plan", report, "-c", "4"]) == 0
    assert a.tree(copy) == a.tree(good)
    with pytest.raises(SystemExit):
        cli.main(["repair", "file:///x", "file:///y", "--plan", report, "--dry-run"])


def test_gzip_edges():
    whole = gzip.compress(b"x" * 1000)
    with pytest.raises(xdr.Broken) as e:
        xdr.gunzip(whole[:-9])
    assert e.value.retry
    with pytest.raises(xdr.Broken):
        list(xdr.records(b"\x80\0\0\x05abc"))
    with pytest.raises(xdr.Broken):
        list(xdr.records(b"\0\0\0\x03abc"))


@pytest.mark.parametrize("plan", [
    {}, {"version": 2, "files": {}, "buckets": [], "checkpoints": []}, {"version": 1, "files": {"64": ["ledger"]}, "buckets": [], "checkpoints": []}, {"version": 1, "files": {"63": ["x"]}, "buckets": [], "checkpoints": []},
    {"version": 1, "files": {}, "buckets": ["zz"], "checkpoints": []}, {"version": 1, "files": {}, "buckets": [], "checkpoints": [5]}, {"version": 1, "files": {}, "buckets": [], "checkpoints": [], "well_known": 1},
])
def test_bad_plans(spark, plan):
    with pytest.raises(reports.InvalidPlan):
        reports.plan_failures(spark, plan)


def test_plan_round_trip(spark):
    plan = {"version": 1, "well_known": 255, "files": {"127": ["ledger", "transactions"], "255": ["history"]}, "buckets": ["ab" * 32], "checkpoints": [191]}
    failures, well_known = reports.plan_failures(spark, plan)
    outcomes = spark.createDataFrame([("processed",)] * 100 + [("skipped",)] * 3, "outcome string")
    body = reports.section(failures, outcomes, well_known)
    assert body["summary"] == {"succeeded": 100, "skipped": 3, "failed": 4, "retries": 0}
    assert {k: body[k] for k in ("well_known", "files", "buckets", "checkpoints")} == {k: plan[k] for k in ("well_known", "files", "buckets", "checkpoints")}


def test_contents_of_asked_files_only(spark, good):
    """A plan of one file reads one file, in the task that owns its row; Spark's readers list and shuffle nothing."""
    from ledgerloom.sources.storage import Archive

    paths = sorted(str(p.relative_to(good)) for p in Path(good).rglob("ledger-*.xdr.gz"))
    asked = spark.createDataFrame([(paths[0], "ledger", 63), ("ledger/none.xdr.gz", "ledger", 127)], "path string, kind string, cp bigint")
    for a in (Archive("file", str(good)), Archive("hadoop", f"file:{good}")):
        found = a.contents(asked)
        got = {r.path: r for r in found.collect()}
        assert bytes(got[paths[0]].content) == (Path(good) / paths[0]).read_bytes() and got[paths[0]].error_class is None
        assert got["ledger/none.xdr.gz"].content is None and got["ledger/none.xdr.gz"].error_class == "not_found"
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "binaryFile" not in plan and "Exchange" not in plan


def test_refused_requests_are_not_missing_files(spark):
    class Refusing(http.server.BaseHTTPRequestHandler):
        def do_HEAD(self):
            self.send_response(403 if "secret" in self.path else 404)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Refusing)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    asked = spark.createDataFrame([("secret.gz",), ("gone.gz",)], "path string")
    rows = archive(f"http://127.0.0.1:{server.server_port}/a", Options(max_retries=0)).present(asked).collect()
    server.shutdown()
    assert {(r.path, r.present, r.error_class) for r in rows} == {("secret.gz", False, "fatal"), ("gone.gz", False, "not_found")}


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from ledgerloom.plans import scratch

    context = SimpleNamespace(master="yarn", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        scratch.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))
