"""Archives as a data source: rows of the decoders, errors as rows, filters that open fewer files."""

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import verify as checks
from ledgerloom.sources import xdr
from ledgerloom.sources.datasource import HASHES, ArchiveReader, ArchiveSource
from ledgerloom.sources.stores import FileStore

from . import archives as a


@pytest.fixture(scope="module")
def good(tmp_path_factory):
    root = tmp_path_factory.mktemp("good")
    a.build(root, 4)
    return root


def load(spark, root, kind, **options):
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("ledger_archive").options(kind=kind, **{"high": 255, "perPartition": 2, "rangeBytes": 500, "maxRetries": 0, **options}).load(f"file://{root}")


@pytest.mark.parametrize("kind", ["ledger", "transactions", "results"])
def test_rows_are_those_of_the_decoders(spark, good, kind):
    df = load(spark, good, kind)
    want = [(cp, r["seq"], *(r[c] for c in HASHES[kind]), a.file_path(kind, cp), None) for cp in (63, 127, 191, 255) for r in xdr.decode(kind, cp, (Path(good) / a.file_path(kind, cp)).read_bytes())]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr) and df.rdd.getNumPartitions() == 2


def test_checks_over_the_source(spark, good, tmp_path):
    assert checks.chain_errors(load(spark, good, "ledger")).collect() == []
    shutil.copytree(good, tmp_path / "t")
    a.build(tmp_path / "o", 4, tamper=lambda seq, tx, res: (b"w" * 32 if seq == 1 else tx, res))
    shutil.copy(tmp_path / "o" / a.file_path("ledger", 191), tmp_path / "t" / a.file_path("ledger", 191))
    assert {(r.error, r.id) for r in checks.chain_errors(load(spark, tmp_path / "t", "ledger")).collect()} == {("boundary", 191), ("boundary", 255)}


def test_errors_are_rows(spark, good, tmp_path):
    shutil.copytree(good, tmp_path / "t")
    (tmp_path / "t" / a.file_path("results", 63)).unlink()
    (tmp_path / "t" / a.file_path("results", 191)).write_bytes(b"no gzip")
    broken = {r.cp: r.error for r in load(spark, tmp_path / "t", "results").where("error IS NOT NULL").collect()}
    assert broken[63].startswith("not_found") and broken[191].startswith("retry") and len(broken) == 2


def test_filters_open_fewer_files(spark, good, tmp_path):
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = load(spark, good, "ledger", perPartition=1, pushdown="true")
        some = df.where((F.col("cp") > 63) & (F.col("cp") <= 191))
        assert {r.cp for r in some.collect()} == {127, 191} and some.rdd.getNumPartitions() == 2
        assert df.where("cp = 255").rdd.getNumPartitions() == 1 and df.where("cp = 64").collect() == []
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


@pytest.mark.parametrize("low, high, per, want", [(63, 255, 64, [(63, 255)]), (64, 255, 2, [(127, 191), (255, 255)]), (63, 62, 1, [(64, 0)]), (0, 63, 1, [(63, 63)])])
def test_runs_of_checkpoints(low, high, per, want):
    assert [(p.low, p.high) for p in ArchiveReader(FileStore("/x"), "ledger", low, high, per).partitions()] == want
