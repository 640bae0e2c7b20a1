"""Verification of a growing archive: equal to a batch scan, whatever order files come in, and over restarts."""

import gzip
import shutil

import pytest

from ledgerloom.plans import operations as ops
from ledgerloom.sources.storage import Options, archive
from ledgerloom.streaming.verification import failed_checkpoints, follow_verified, latest

from . import archives as a

QUICK = Options(max_retries=1, retry_min_delay=0.01)
KINDS = ("ledger", "transactions", "results")


def run(spark, root, tmp_path, **kw):
    follow_verified(spark, archive(f"file://{root}", QUICK), str(tmp_path / "table"), str(tmp_path / "checkpoint"), **kw).awaitTermination()
    return {r.cp: r for r in latest(spark, str(tmp_path / "table")).collect()}


def add(source, target, cp, *kinds):
    for kind in kinds:
        path = a.file_path(kind, cp)
        (target / path).parent.mkdir(parents=True, exist_ok=True)
        shutil.copy(source / path, target / path)


def batch_scan(spark, root):
    try:
        return ops.scan(spark, archive(f"file://{root}", QUICK), verify=True).report["checkpoints"]
    except ops.OperationFailed as e:
        return e.result.report["checkpoints"]


@pytest.fixture(scope="module")
def whole(tmp_path_factory):
    """Four checkpoints: a wrong set in the second, a wrong result in the third, and a chain that breaks before the fourth."""
    root, other = tmp_path_factory.mktemp("whole"), tmp_path_factory.mktemp("other")
    wrong = b"w" * 32
    tamper = lambda seq, tx, res: (wrong if seq == 71 else tx, wrong if seq == 140 else res)
    a.build(root, 4, tamper=tamper)
    a.build(other, 4, tamper=lambda seq, tx, res: (wrong if seq == 1 else tx, res))
    add(other, root, 255, *KINDS)
    return root


def test_equal_to_a_scan_over_batches_and_restarts(spark, whole, tmp_path):
    root = tmp_path / "archive"
    add(whole, root, 63, *KINDS)
    add(whole, root, 127, "results")
    found = run(spark, root, tmp_path)
    assert found[63].missing == [] and found[63].errors == []
    assert found[127].missing == ["ledger", "transactions"]
    # each call is a restart: state of open checkpoints comes back from the stream's checkpoint
    add(whole, root, 255, "ledger", "transactions")
    add(whole, root, 127, "ledger")
    found = run(spark, root, tmp_path)
    assert found[127].missing == ["transactions"] and found[127].errors == []
    assert found[255].missing == ["results"] and found[255].errors == []
    add(whole, root, 191, *KINDS)
    add(whole, root, 127, "transactions")
    found = run(spark, root, tmp_path)
    assert [(e.error, e.id) for e in found[127].errors] == [("ledger", 71)]
    assert [(e.error, e.id) for e in found[191].errors] == [("ledger", 140)]
    assert [(e.error, e.id) for e in found[255].errors] == [("boundary", 255)] and found[255].missing == ["results"]
    add(whole, root, 255, "results")
    found = run(spark, root, tmp_path)
    assert all(r.missing == [] for cp, r in found.items() if cp <= 255)
    ends = sorted(r.cp for r in failed_checkpoints(spark, str(tmp_path / "table")).collect())
    assert ends == batch_scan(spark, whole) == [127, 191, 255]


def test_damage_and_empty_files(spark, tmp_path):
    root = tmp_path / "archive"
    a.build(root, 3)
    (root / a.file_path("ledger", 127)).write_bytes(b"no gzip")
    (root / a.file_path("ledger", 191)).write_bytes(gzip.compress(b""))
    run(spark, root, tmp_path)
    ends = sorted(r.cp for r in failed_checkpoints(spark, str(tmp_path / "table")).collect())
    assert ends == batch_scan(spark, root) == [127, 191]


def test_what_stays_open_is_told_overdue(spark, whole, tmp_path):
    root = tmp_path / "archive"
    add(whole, root, 63, *KINDS)
    add(whole, root, 191, "ledger", "results")
    found = run(spark, root, tmp_path, patience_seconds=0, skew="0 seconds")
    add(whole, root, 127, "ledger")
    found = run(spark, root, tmp_path, patience_seconds=0, skew="0 seconds")
    assert found[191].overdue and found[191].missing == ["transactions"] and not found[63].overdue
