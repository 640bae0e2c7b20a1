import json

from ledgerloom.sources.storage import archive
from ledgerloom.streaming.follow import follow

from . import archives as a


def test_each_state_once(spark, tmp_path):
    root = tmp_path / "archive"
    a.build(root, 2)
    run = lambda: follow(spark, archive(f"file://{root}"), str(tmp_path / "table"), str(tmp_path / "checkpoint")).awaitTermination()
    run()
    rows = lambda: {(r.kind, r.path) for r in spark.read.parquet(str(tmp_path / "table")).collect()}
    first = rows()
    assert len([k for k, _ in first if k == "bucket"]) == 3 and len(first) == 11
    shared = json.loads((root / a.file_path("history", 63)).read_text())["currentBuckets"][0]["curr"]
    a.write(root, a.file_path("history", 191), json.dumps(a.state(191, [shared, "cd" * 32])).encode())
    a.write(root, a.file_path("history", 255), b"no json")
    run()
    new = rows() - first
    assert ("bucket", a.bucket_path("cd" * 32)) in new and len(new) == 5
    assert spark.read.parquet(str(tmp_path / "table")).count() == 16
