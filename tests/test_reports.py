"""Reports and plans that stay in Spark: the same bytes and errors, without a list on the driver."""

import json
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import bounds
from ledgerloom.operators import report as reports

DDL = "kind string, cp bigint, flag int, hash string"


def failures(spark, n):
    ids = spark.range(n).repartition(5)
    cp = F.col("id") * 64 + 63
    none = F.lit(None)
    files = ids.select(F.lit("file").alias("kind"), cp.alias("cp"), F.explode(F.array(F.lit(1), F.lit(4))).alias("flag"), none.cast("string").alias("hash"))
    marked = ids.select(F.lit("checkpoint"), cp, none.cast("int"), none.cast("string"))
    return files.union(marked).union(ids.select(F.lit("bucket"), none.cast("bigint"), none.cast("int"), F.sha2(F.col("id").cast("string"), 256)))


def empty(spark):
    return spark.createDataFrame([], "outcome string")


@pytest.mark.parametrize("n", [0, 1, 3, 1200])
def test_bytes_are_those_of_one_json_text(spark, tmp_path, monkeypatch, n):
    monkeypatch.setattr(reports, "FRAGMENT", 100)
    section = reports.section(failures(spark, n), empty(spark), 63 if n else None)
    for report in (reports.single(section), reports.multi({"main_pass": section, "file_retry": reports.section(failures(spark, 2), empty(spark)), "none": {}})):
        path = tmp_path / "r.json"
        reports.write(str(path), report)
        assert "files" not in section.known  # written without a look at the entries
        plain = json.loads(path.read_text())
        assert path.read_text() == json.dumps(plain, indent=2)
    assert dict(section) == plain["sections"]["main_pass"] and reports.single(section)["version"] == 1
    body = plain["sections"]["main_pass"]
    assert list(body["files"]) == sorted(map(str, range(63, 64 * n + 63, 64))) and body["checkpoints"] == list(range(63, 64 * n + 63, 64)) and body["buckets"] == sorted(body["buckets"])


def test_a_long_plan_stays_in_spark(spark, tmp_path, monkeypatch):
    """A million entries: written, read back and joined; nothing is fetched but counts, one line of sizes and the first error."""
    from pyspark.sql.classic.dataframe import DataFrame

    n = 250_000
    given, path, fetched = failures(spark, n), str(tmp_path / "plan.json"), []
    collect = DataFrame.collect

    def counted(self):
        out = collect(self)
        fetched.append(len(out))
        return out

    monkeypatch.setattr(DataFrame, "collect", counted)
    began = time.monotonic()
    reports.write(path, reports.single(reports.section(given, empty(spark), 127)))
    found, well_known = reports.plan_failures(spark, path)
    assert well_known == 127 and found.count() == 4 * n
    assert found.select("kind", "cp", "flag", "hash").exceptAll(given).isEmpty()
    assert max(fetched) <= 2 and time.monotonic() - began < 200


@pytest.mark.parametrize("change, told", [
    ({"version": 2}, "version"), ({"version": "1"}, "version"), ({"files": None}, "needs"), ({"sections": {}, "files": None}, "needs"), ({"files": {"64": ["ledger"]}}, "not a checkpoint"), ({"files": {"x": ["ledger"]}}, "key"), ({"files": {"-1": ["ledger"]}}, "key"),
    ({"files": {"63": ["x"]}}, "unknown file type"), ({"files": {"63": [1]}}, "unknown file type"), ({"files": {"+63": ["bucket"]}}, "unknown file type"), ({"checkpoints": ["63"]}, "not a checkpoint"), ({"checkpoints": [63.5]}, "not a checkpoint"), ({"checkpoints": [True]}, "not a checkpoint"),
    ({"checkpoints": [2**32 + 63]}, "not a checkpoint"), ({"checkpoints": [None]}, "not a checkpoint"), ({"well_known": 5}, "not a checkpoint"), ({"well_known": "63"}, "not a checkpoint"), ({"buckets": ["ab" * 31]}, "not a hash"), ({"buckets": [7]}, "not a hash"), ({"buckets": "no list"}, "form"), ({"files": []}, "form"),
])
@pytest.mark.parametrize("as_file", [False, True])
def test_errors_of_plans(spark, tmp_path, change, told, as_file):
    plan = {"version": 1, "well_known": None, "files": {"63": ["ledger"]}, "buckets": ["AB" * 32], "checkpoints": [127]} | change
    plan = {k: v for k, v in plan.items() if v is not None or k == "well_known"}
    if as_file:
        (tmp_path / "plan.json").write_text(json.dumps(plan))
        plan = str(tmp_path / "plan.json")
    with pytest.raises(reports.InvalidPlan) as e:
        reports.plan_failures(spark, plan)
    assert told in str(e.value)


def test_no_json(spark, tmp_path):
    for text in ("no json", "", "[]", '{"version": 1'):
        (tmp_path / "plan.json").write_text(text)
        with pytest.raises(reports.InvalidPlan):
            reports.plan_failures(spark, str(tmp_path / "plan.json"))


def test_a_good_plan(spark):
    plan = {"version": 1, "files": {"+63": ["ledger", "scp"], "127": []}, "buckets": ["AB" * 32], "checkpoints": [127, 127], "unknown": {"x": 1}}
    found, well_known = reports.plan_failures(spark, plan)
    assert well_known is None
    assert {tuple(r) for r in found.collect()} == {("file", 63, 2, None), ("file", 63, 16, None), ("bucket", None, None, "ab" * 32), ("checkpoint", 127, None, None)}


def slow_mirror(latest, existing, low, overwrite, gaps):
    first = 63 if low is None else max(63, (low + 1) // 64 * 64 - 1)
    if first > latest:
        return "below"
    if existing is not None and existing >= latest and not overwrite:
        return latest + 64
    if low is None:
        return 63 if overwrite or existing is None else existing + 64
    if existing is None or overwrite or first > existing:
        return "gap" if existing is not None and first > existing and not gaps else first
    return existing + 64


def test_mirror_bounds_of_many(spark):
    rows = [(latest, existing, low, overwrite, gaps) for latest in (63, 639) for existing in (None, 63, 255, 639, 1023) for low in (None, 0, 100, 255, 400, 639, 5000) for overwrite in (False, True) for gaps in (False, True)]
    df = spark.createDataFrame(rows, "latest long, existing long, low long, overwrite boolean, gaps boolean")
    none = F.lit(None).cast("long")
    b = bounds.mirror_bounds_column(F.col("latest"), F.col("existing"), F.col("low"), none, F.col("overwrite"), F.col("gaps"))
    for r in df.select("*", b.alias("b")).collect():
        want = slow_mirror(*r[:5])
        assert (r.b.error or r.b.low) == want, r
