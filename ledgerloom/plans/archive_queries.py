"""Queries that run storage and whole operations: archives are derived from the tables, in the shared folder, and then copied, scanned and mended.

Documents stand for buckets, an order for a ledger. Which files are damaged
or missing follows from their numbers, so that SQL can tell the outcome.
"""

from __future__ import annotations

import gzip
import os
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import checkpoints as cps
from ledgerloom.functions.states import LEVELS
from ledgerloom.operators import bounds as limits
from ledgerloom.operators import report as reports
from ledgerloom.sources.decode import decoded, written
from ledgerloom.sources.storage import Archive, Options, archive

from . import operations
from .scratch import cut, shared_dir
from .table_queries import _F, _PREFIX, ORACLE_SQL, QUERIES, _failure_set, _query, _seq, _table

POINTER = ".well-known/root.json"


def derived(spark: SparkSession, name: str) -> Archive:
    """A new archive in the folder that driver and executors share."""
    root = shared_dir(spark)
    if root.startswith("file:"):
        root = urlparse(root).path
    if "://" not in root:
        root = f"file://{os.path.abspath(root)}"
    return archive(f"{root.rstrip('/')}/ledgerloom/{name}-{uuid.uuid4().hex}", Options(max_retries=1, retry_min_delay=0.0))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gzip of texts: every third as it is, cut at its end, or of other content, as ``damage`` says."""
    for batch in batches:
        for i in range(batch.num_rows):
            damage, text = batch.column("damage")[i].as_py(), batch.column("text")[i].as_py()
            data = gzip.compress((text + "x" if damage == 1 else text).encode(), 1, mtime=0)
            yield pa.RecordBatch.from_arrays([batch.column("path").slice(i, 1), pa.array([data[:-5] if damage == 0 else data]), pa.array([None], pa.string())], names=["path", "content", "error_class"])


@_query("""WITH g AS (SELECT doc_id // 64 AS n, (doc_id // 64) || ':' || string_agg(text, '' ORDER BY doc_id, text) AS t FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id // 64)
SELECT sha256(t) AS hash, CASE n % 7 WHEN 0 THEN 'retry' WHEN 1 THEN 'fatal' WHEN 2 THEN 'not_found' END AS error_class, n % 7 > 2 AS present, CAST(CASE WHEN n % 7 > 2 THEN strlen(t) ELSE 0 END AS BIGINT) AS verified FROM g""")
def bucket_copies(spark: SparkSession, d: str) -> DataFrame:
    """Buckets of the texts of 64 documents each, written to an archive, some cut, some of wrong content, some not at all; copied to another with a check of each hash; then looked for there."""
    n, texts = F.floor(F.col("doc_id") / 64), F.array_sort(F.collect_list(F.struct("doc_id", "text")))
    whole = _table(spark, d, "documents").where("text IS NOT NULL AND doc_id IS NOT NULL").groupBy(n.alias("n")).agg(texts.alias("texts"))
    one = whole.select("n", F.concat(F.col("n").cast("string"), F.lit(":"), F.array_join(F.transform("texts", lambda x: x.text), "")).alias("text")).withColumn("hash", F.sha2("text", 256))
    buckets = one.select("hash", cps.bucket_path(F.col("hash")).alias("path"), "text", (F.col("n") % 7).alias("damage"), F.lit("bucket").alias("kind"), (F.col("n") * 64 + 63).alias("cp"))
    source, target = derived(spark, "buckets"), derived(spark, "copies")
    made = buckets.where("damage != 2").select("path", "text", "damage").mapInArrow(_packed, "path string, content binary, error_class string")
    asked = cut(buckets.select("hash", "path", "kind", "cp"))
    cut(written(made, source))
    read = cut(decoded(asked, source, target))
    there = cut(target.present(asked.select("hash", "path"))).select("hash", "present")
    told = read.select("path", "error_class", F.when(F.col("parsed"), F.col("bytes_out")).otherwise(0).alias("verified"))
    return asked.select("hash", "path").join(told, "path").join(there, "hash").select("hash", "error_class", "present", "verified")


_CPS = "c AS (SELECT CAST(unnest(generate_series(63, (SELECT max(o_orderkey) FROM orders) // 64 * 64 + 63, 64)) AS BIGINT) AS cp)"
_FILES = f"""f AS (SELECT cp, k.kind, k.no, k.kind || '/' || {_PREFIX} || '/' || k.kind || '-' || printf('%08x', cp) || CASE k.kind WHEN 'history' THEN '.json' ELSE '.xdr.gz' END AS path
  FROM c, (VALUES ('history', 0), ('ledger', 1), ('transactions', 2), ('results', 3), ('scp', 4)) AS k(kind, no)),
b AS (SELECT min(cp) AS cp, sha256('b' || cp // 256) AS h FROM c GROUP BY cp // 256)"""


def _checkpoints(spark: SparkSession, d: str) -> DataFrame:
    last = _seq(spark, d).agg(F.max("seq").alias("last"))
    return last.select(F.explode(F.sequence(F.lit(cps.FIRST).cast("bigint"), cps.ceil_checkpoint(F.col("last")), F.lit(cps.FREQUENCY).cast("bigint"))).alias("cp"))


def _history(cp: Column) -> Column:
    """A state as JSON: one bucket, shared by up to four checkpoints."""
    level = lambda h: F.struct(h.alias("curr"), F.lit("0" * 64).alias("snap"), F.struct(F.lit(0).alias("state")).alias("next"))
    levels = F.concat(F.array(level(_bucket(cp))), F.array_repeat(level(F.lit("0" * 64)), LEVELS - 1))
    return F.to_json(F.struct(F.lit(1).alias("version"), F.lit("tables").alias("server"), cp.alias("currentLedger"), levels.alias("currentBuckets")))


def _bucket(cp: Column) -> Column:
    return F.sha2(F.concat(F.lit("b"), F.floor(cp / 256).cast("string")), 256)


def _all_files(checkpoints: DataFrame) -> DataFrame:
    """(path, kind, cp, content, error_class) of a whole archive."""
    cp = F.col("cp")
    files = operations.history_files(checkpoints).unionByName(operations.checkpoint_files(checkpoints, False))
    files = files.select("path", "kind", "cp", F.when(F.col("kind") == "history", _history(cp)).otherwise(F.col("path")).cast("binary").alias("content"))
    buckets = checkpoints.groupBy(_bucket(cp).alias("hash")).agg(F.min("cp").alias("cp")).select(cps.bucket_path(F.col("hash")).alias("path"), F.lit("bucket").alias("kind"), "cp", F.col("hash").cast("binary").alias("content"))
    return files.unionByName(buckets).withColumn("error_class", F.lit(None).cast("string"))


def _number_of(kind: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for k, n in {"history": 0, "ledger": 1, "transactions": 2, "results": 3, "scp": 4, "bucket": 0}.items() for x in (k, n))), kind)


def _pair(spark: SparkSession, d: str) -> tuple[Archive, Archive]:
    """A whole archive, and one that lacks about a half; neither file of the second is of other content."""
    source, target = derived(spark, "source"), derived(spark, "target")
    files = cut(_all_files(_checkpoints(spark, d)))
    cut(written(files, source))
    step = F.floor(F.col("cp") / 64)
    some = F.when(F.col("kind") == "history", step % 2 == 0).when(F.col("kind") == "bucket", F.floor(step / 4) % 2 == 0).otherwise((step + _number_of(F.col("kind"))) % 3 == 0)
    cut(written(files.where(some), target))
    last = files.where("kind = 'history'").orderBy(F.desc("cp")).first()
    source.write(POINTER, bytes(last.content))
    return source, target


@_query(f"""WITH {_CPS}, {_FILES}
SELECT cp, kind, path, CASE WHEN kind = 'history' AND cp // 64 % 2 = 0 OR kind <> 'history' AND (cp // 64 + no) % 3 = 0 THEN 'skipped' ELSE 'processed' END AS mirrored, 'processed' AS scanned FROM f
UNION ALL SELECT cp, 'bucket', 'bucket/' || h[1:2] || '/' || h[3:4] || '/' || h[5:6] || '/bucket-' || h || '.xdr.gz', CASE WHEN cp // 256 % 2 = 0 THEN 'skipped' ELSE 'processed' END, 'processed' FROM b""")
def archive_mirror(spark: SparkSession, d: str) -> DataFrame:
    """What a mirror did with each file of an archive with a checkpoint for every 64 orders, and what a scan of the copy says then."""
    source, target = _pair(spark, d)
    done = operations.mirror(spark, source, target, root_pointer=POINTER).outcomes.select("cp", "kind", "path", F.col("outcome").alias("mirrored"))
    after = operations.scan(spark, target, root_pointer=POINTER).outcomes.select("path", F.col("outcome").alias("scanned"))
    return done.join(after, "path").select("cp", "kind", "path", "mirrored", "scanned")


@_query(f"""WITH {_CPS}, {_FILES}, m AS (
  SELECT 'file' AS kind, cp, CAST(1 << no AS INTEGER) AS flag, CAST(NULL AS VARCHAR) AS hash FROM f WHERE kind = 'history' AND cp // 64 % 2 = 1 OR kind <> 'history' AND (cp // 64 + no) % 3 <> 0
  UNION ALL SELECT 'bucket', NULL, NULL, h FROM b WHERE cp // 256 % 2 = 1)
SELECT kind, cp, flag, hash, false AS left_over FROM m""")
def archive_repair(spark: SparkSession, d: str) -> DataFrame:
    """The failures that a dry repair plans for an archive that lacks about a half, and whether any is left after a repair by that plan, read back from its file."""
    source, target = _pair(spark, d)
    target.write(POINTER, source.read(POINTER))
    plan = f"{tempfile.mkdtemp(prefix='ledgerloom-')}/plan.json"
    operations.repair(spark, source, target, dry_run=True, report_path=plan, root_pointer=POINTER)
    failures, _ = reports.plan_failures(spark, plan)
    failures = cut(failures)
    operations.repair(spark, source, target, plan=plan)
    broken = cut(operations.scan(spark, target, root_pointer=POINTER).failures.withColumn("left_over", F.lit(True)))
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("kind", "cp", "flag", "hash")]
    return failures.alias("f").join(broken.alias("b"), same, "left").select("f.kind", "f.cp", "f.flag", "f.hash", F.coalesce("b.left_over", F.lit(False)).alias("left_over"))


@_query(f"""WITH {_F} SELECT 'file' AS kind, cp, CAST(1 << k AS INTEGER) AS flag, CAST(NULL AS VARCHAR) AS hash FROM flags, (SELECT unnest(range(5)) AS k) WHERE flags & CAST(1 << k AS INTEGER) <> 0
UNION ALL SELECT 'checkpoint', cp, NULL, NULL FROM (SELECT DISTINCT cp FROM marked) UNION ALL SELECT 'bucket', NULL, NULL, hash FROM (SELECT DISTINCT hash FROM buckets)""")
def report_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A failure set written as a report's file and read back as a plan."""
    failures = cut(_failure_set(spark, d))
    path = f"{tempfile.mkdtemp(prefix='ledgerloom-')}/report.json"
    reports.write(path, reports.single(reports.section(failures, spark.createDataFrame([], "outcome string"))))
    return reports.plan_failures(spark, path)[0]


_RULE = """CASE WHEN part <> 'buckets' AND NOT (cp > 0 AND (cp + 1) % 64 = 0 AND cp <= 4294967295) THEN 'not a checkpoint'
  WHEN part = 'files' AND name NOT IN ('history', 'ledger', 'transactions', 'results', 'scp') THEN 'unknown file type'
  WHEN part = 'buckets' AND NOT regexp_full_match(name, '[0-9a-fA-F]{64}') THEN 'not a hash' END"""


@_query(f"""WITH e AS (SELECT CAST(l_orderkey AS BIGINT) AS seq, l_linenumber AS line, CASE l_linenumber % 3 WHEN 0 THEN 'files' WHEN 1 THEN 'buckets' ELSE 'checkpoints' END AS part,
  CASE WHEN l_orderkey % 5 = 0 THEN l_orderkey * 64 + 63 ELSE l_orderkey END AS cp,
  CASE WHEN l_linenumber % 3 = 0 THEN CASE WHEN l_orderkey % 4 = 0 THEN 'bucket' ELSE 'ledger' END WHEN l_orderkey % 7 = 0 THEN 'no hash' ELSE upper(sha256(CAST(l_orderkey AS VARCHAR))) END AS name FROM lineitem)
SELECT seq, line, part, {_RULE} AS error FROM e""")
def plan_rules(spark: SparkSession, d: str) -> DataFrame:
    """The rule that each entry of a plan breaks: files, buckets and checkpoints."""
    seq, line = F.col("l_orderkey").cast("bigint"), F.col("l_linenumber")
    part = F.when(line % 3 == 0, "files").when(line % 3 == 1, "buckets").otherwise("checkpoints")
    name = F.when(line % 3 == 0, F.when(seq % 4 == 0, "bucket").otherwise("ledger")).when(seq % 7 == 0, "no hash").otherwise(F.upper(F.sha2(seq.cast("string"), 256)))
    error = reports.entry_error(part, F.when(seq % 5 == 0, seq * 64 + 63).otherwise(seq), name)
    return _table(spark, d, "lineitem").select(seq.alias("seq"), line.alias("line"), part.alias("part"), error.alias("error"))


@_query("""WITH r AS (SELECT CAST(o_orderkey AS BIGINT) AS seq, o_custkey % 200 * 64 + 63 AS latest, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 9000 END AS low, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 15000 END AS high FROM orders),
b AS (SELECT seq, latest, CASE WHEN low IS NULL THEN 63 ELSE greatest(63, (low + 1) // 64 * 64 - 1) END AS first, coalesce(high // 64 * 64 + 63, latest) AS asked FROM r)
SELECT seq, CAST(first AS BIGINT) AS low, CAST(least(asked, latest) AS BIGINT) AS high, CASE WHEN first > latest THEN 'below' WHEN first > least(asked, latest) THEN 'above' END AS error, asked > latest AS warned FROM b""")
def scan_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of scans and repairs, for many archives and limits at once."""
    seq, latest = F.col("o_orderkey").cast("bigint"), (F.col("o_custkey") % 200 * 64 + 63).cast("bigint")
    b = limits.archive_bounds_column(latest, F.when(seq % 3 != 0, seq % 9000), F.when(seq % 4 != 0, seq % 15000))
    return _table(spark, d, "orders").select(seq.alias("seq"), b.alias("b")).select("seq", "b.low", "b.high", "b.error", F.col("b.warning").isNotNull().alias("warned"))


__all__ = ["ORACLE_SQL", "QUERIES"]
