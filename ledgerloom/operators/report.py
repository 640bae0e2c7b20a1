"""Reports and plans: the deterministic JSON body of a failure set, and back.

Entries stay in Spark: a report is written from ordered fragments of text that
tasks make, and a plan is parsed, checked and turned into failures by tasks. The
driver holds what it is asked for: counts, the first error, or an entry list
that a caller looks at.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator, Mapping

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.checkpoints import flag_names, flag_of_kind, is_checkpoint, is_valid_hash

from . import failures as failing

VERSION = 1
MOST_ENTRIES = 10_000_000
PARTS = {"files": "file", "buckets": "bucket", "checkpoints": "checkpoint"}


class InvalidPlan(ValueError):
    pass


class Section(Mapping):
    """A report's body. Its lists of entries are fetched when they are looked at; ``write`` does not fetch them."""

    KEYS = ("well_known", "files", "buckets", "checkpoints", "summary")

    def __init__(self, failures: DataFrame, outcomes: DataFrame, well_known: int | None):
        self.rows, self.known = entries(failures), {"well_known": well_known, "summary": failing.summary(outcomes, failures).first().asDict()}

    def __iter__(self) -> Iterator[str]:
        return iter(self.KEYS)

    def __len__(self) -> int:
        return len(self.KEYS)

    def __repr__(self) -> str:
        return f"Section({dict(self)})"

    def __getitem__(self, key: str):
        if key not in self.KEYS:
            raise KeyError(key)
        if key not in self.known:
            found = ordered(self.rows, key).collect()
            self.known[key] = {r.key: r.names for r in found} if key == "files" else [int(r.key) if key == "checkpoints" else r.key for r in found]
        return self.known[key]


def section(failures: DataFrame, outcomes: DataFrame, well_known: int | None = None) -> Section:
    """A report's body: what failed. More than ``MOST_ENTRIES`` make no plan and raise ``InvalidPlan``."""
    out = Section(failures, outcomes, well_known)
    if (n := out.rows.count()) > MOST_ENTRIES:
        raise InvalidPlan(f"report has {n} entries, exceeds maximum {MOST_ENTRIES}")
    return out


def ordered(rows: DataFrame, part: str) -> DataFrame:
    """Entries of a part in the report's order: files and buckets as text, checkpoints as numbers."""
    return rows.where(F.col("part") == part).orderBy(F.col("key").cast("bigint") if part == "checkpoints" else F.col("key"))


def entries(failures: DataFrame) -> DataFrame:
    """(part, key, names): a report's entries; part is files, buckets or checkpoints."""
    none = F.lit(None).cast("array<string>")
    listed = lambda kind, part, column: failures.where(F.col("kind") == kind).select(F.lit(part).alias("part"), F.col(column).cast("string").alias("key"), none.alias("names")).distinct()
    files = failing.file_flags(failures).select(F.lit("files").alias("part"), F.col("cp").cast("string").alias("key"), flag_names(F.col("flags")).alias("names"))
    return files.unionByName(listed("bucket", "buckets", "hash")).unionByName(listed("checkpoint", "checkpoints", "cp"))


def entry_error(part: Column, checkpoint: Column, name: Column) -> Column:
    """The rule that a plan's entry breaks, or null: ``checkpoint`` of files and checkpoints, ``name`` of a file's kind or a bucket's hash."""
    fits = F.coalesce(is_checkpoint(checkpoint) & (checkpoint <= 2**32 - 1), F.lit(False))
    return (
        F.when((part != "buckets") & ~fits, "not a checkpoint")
        .when((part == "files") & flag_of_kind(name).isNull(), "unknown file type")
        .when((part == "buckets") & ~F.coalesce(is_valid_hash(name), F.lit(False)), "not a hash")
    )


def single(body: Mapping) -> Report:
    return Report(body)


def multi(sections: dict[str, dict]) -> dict:
    return {"version": VERSION, "sections": sections}


#: Entries of a fragment that a task makes for the report's file.
FRAGMENT = 5000


def fragments(rows: DataFrame, part: str, indent: str) -> Iterator[str]:
    """The entries of a part as JSON text, some thousands at a time, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FRAGMENT):
                some = batch.slice(at, FRAGMENT)
                keys, names = some.column("key").to_pylist(), some.column("names").to_pylist()
                if part == "files":
                    lines = [f"{json.dumps(k)}: {_indented(v, indent)}" for k, v in zip(keys, names, strict=True)]
                else:
                    lines = [k if part == "checkpoints" else json.dumps(k) for k in keys]
                yield pa.RecordBatch.from_arrays([pa.array([(",\n" + indent).join(lines)], pa.string())], names=["text"])

    # one partition at a time passes the driver
    for r in ordered(rows, part).select("key", "names").mapInArrow(run, "text string").toLocalIterator(prefetchPartitions=True):
        yield r.text


def _indented(value: object, indent: str) -> str:
    return json.dumps(value, indent=2).replace("\n", f"\n{indent}")


def pieces(value: object, indent: str = "") -> Iterator[str]:
    """JSON of a report as ``json.dumps(value, indent=2)`` writes it, in pieces."""
    if not isinstance(value, Mapping) or not value:
        yield _indented(value, indent)
        return
    inner, before = indent + "  ", "{\n"
    body = value.body if isinstance(value, Report) else value
    for key in value:
        yield f"{before}{inner}{json.dumps(key)}: "
        before = ",\n"
        if isinstance(body, Section) and key in PARTS and key not in body.known:
            start, stop = "{}" if key == "files" else "[]"
            any_yet = False
            for text in fragments(body.rows, key, inner + "  "):
                yield f"{',' if any_yet else start}\n{inner}  {text}"
                any_yet = True
            yield f"\n{inner}{stop}" if any_yet else start + stop
        else:
            yield from pieces(value[key], inner)
    yield f"\n{indent}}}"


class Report(Mapping):
    """A section with the version in front."""

    def __init__(self, body: Mapping):
        self.body = body

    def __getitem__(self, key: str):
        return VERSION if key == "version" else self.body[key]

    def __iter__(self) -> Iterator[str]:
        yield "version"
        yield from self.body

    def __len__(self) -> int:
        return 1 + len(self.body)

    def __repr__(self) -> str:
        return f"Report({dict(self)})"


def write(path: str, report: Mapping) -> None:
    """One JSON file, put in place when it is whole."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    temporary = f"{path}.tmp"
    with open(temporary, "w", encoding="utf-8") as f:
        f.writelines(pieces(report))
    os.replace(temporary, path)


def read(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def plan_version_error(version: Column) -> Column:
    return F.when(F.coalesce(version != VERSION, F.lit(True)), "unsupported version")


#: Values are kept as they are typed in the file: 63 is a checkpoint, "63" is none.
PLAN = "version variant, well_known variant, files map<string, array<variant>>, buckets array<variant>, checkpoints array<variant>"
_SHAPE = "a plan needs version, files, buckets and checkpoints; reports of several sections are no plans"


def plan_rows(spark: SparkSession, plan: Mapping | str) -> DataFrame:
    """A plan, given as a path or an object, as one row of ``PLAN``: parsed by a task."""
    if isinstance(plan, str):
        where = plan if "://" in plan else _shared(spark, os.path.abspath(plan))
        return spark.read.schema(PLAN).option("multiLine", True).option("mode", "FAILFAST").json(where)
    if not isinstance(plan, Mapping):
        raise InvalidPlan(_SHAPE)
    text = "".join(pieces(plan))
    return spark.createDataFrame([(text,)], "text string").select(F.from_json("text", PLAN, {"mode": "FAILFAST"}).alias("p")).select("p.*")


def _shared(spark: SparkSession, path: str) -> str:
    """A file of the driver where tasks can read it: on a cluster, a copy in the shared folder."""
    if re.match(r"local(\[|$)", spark.sparkContext.master):
        return f"file://{path}"
    from ledgerloom.plans.scratch import shared_dir

    jvm = spark.sparkContext._jvm
    target = f"{shared_dir(spark).rstrip('/')}/ledgerloom/plan-{uuid.uuid4().hex}.json"
    there = jvm.org.apache.hadoop.fs.Path(target)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyFromLocalFile(jvm.org.apache.hadoop.fs.Path(f"file://{path}"), there)
    return target


def plan_entries(plan: DataFrame) -> DataFrame:
    """(part, cp, name, broken) of a plan's row: every entry, and the rule it breaks."""
    typed = lambda v, kind: F.schema_of_variant(v).isin(*kind)
    number = lambda v: F.when(typed(v, ("BIGINT",)), F.try_variant_get(v, "$", "bigint"))
    text = lambda v: F.try_variant_get(v, "$", "string")
    none = F.lit(None)
    files = plan.select(F.explode("files").alias("key", "names")).select("key", F.explode("names").alias("v"))
    digits = F.when(F.col("key").rlike(r"^\+?[0-9]+$"), F.regexp_replace("key", r"^\+", ""))
    files = files.select(F.lit("files").alias("part"), F.expr("try_cast(key AS bigint)").alias("cp"), text(F.col("v")).alias("name"), digits.isNull().alias("odd_key"))
    buckets = plan.select(F.explode("buckets").alias("v")).select(F.lit("buckets").alias("part"), none.cast("bigint").alias("cp"), text(F.col("v")).alias("name"), F.lit(False).alias("odd_key"))
    checkpoints = plan.select(F.explode("checkpoints").alias("v")).select(F.lit("checkpoints").alias("part"), number(F.col("v")).alias("cp"), none.cast("string").alias("name"), F.lit(False).alias("odd_key"))
    known = plan.where("well_known IS NOT NULL AND NOT is_variant_null(well_known)").select(F.lit("checkpoints").alias("part"), number(F.col("well_known")).alias("cp"), F.lit("well known").alias("name"), F.lit(False).alias("odd_key"))
    rows = files.unionByName(buckets).unionByName(checkpoints).unionByName(known)
    broken = F.when(F.col("odd_key"), "invalid checkpoint key").otherwise(entry_error(F.col("part"), F.col("cp"), F.col("name")))
    return rows.select("part", "cp", "name", broken.alias("broken"))


def plan_failures(spark: SparkSession, plan: Mapping | str) -> tuple[DataFrame, int | None]:
    """(failures, well_known) of a single-section report, given as a path or an object; anything out of order raises ``InvalidPlan``.

    The driver gets the plan's version, its sizes and the first error; entries
    stay in Spark.
    """
    try:
        row = plan_rows(spark, plan)
        size = lambda c: F.coalesce(F.size(c), F.lit(0))
        n = F.coalesce(F.aggregate(F.map_values("files"), F.lit(0).cast("bigint"), lambda a, names: a + F.size(names)), F.lit(0)) + size("buckets") + size("checkpoints")
        version = F.when(F.schema_of_variant("version") == "BIGINT", F.try_variant_get("version", "$", "bigint"))
        whole = F.col("version").isNotNull() & F.col("files").isNotNull() & F.col("buckets").isNotNull() & F.col("checkpoints").isNotNull()
        head = row.select(whole.alias("whole"), version.alias("version"), n.alias("n"), F.size("files").alias("keys")).head(2)
        if len(head) != 1 or not head[0].whole:
            raise InvalidPlan(_SHAPE)
        if head[0].version != VERSION:
            raise InvalidPlan(f"unsupported report version {head[0].version} (expected {VERSION})")
        if head[0].n > MOST_ENTRIES:
            raise InvalidPlan(f"plan has {head[0].n} entries, exceeds maximum {MOST_ENTRIES}")
        given = plan_entries(row)
        for r in given.where("broken IS NOT NULL").orderBy("part", "cp", "name").head(1):
            raise InvalidPlan(f"{r.part}: {r.name if r.cp is None else r.cp} ({r.name}): {r.broken}")
        known = given.where("part = 'checkpoints' AND name IS NOT NULL").select("cp").head(1)
    except (PySparkException, Py4JJavaError) as e:
        raise InvalidPlan(f"the plan is not of a report's form: {str(e).splitlines()[0]}") from e
    listed = given.where("part != 'checkpoints' OR name IS NULL")
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in PARTS.items() for x in pair)), F.col("part"))
    flag, bucket = F.when(F.col("part") == "files", flag_of_kind(F.col("name"))), F.when(F.col("part") == "buckets", F.lower("name"))
    return listed.select(kind.alias("kind"), "cp", flag.alias("flag"), bucket.alias("hash")).distinct(), known[0].cp if known else None
