"""Merkle manifest of a dataset, with a proof for every row that a recursive query climbs.

Rows are leaves of one tree for each source; the roots of these trees are the
leaves of a tree above. Sixteen consecutive nodes form a run, whose hash is
their parent. Built runs are stored as rows that know their children's hashes
and name their own parent; ``climb`` is a recursive query over them. A row of it
is a run of leaves: the leaves of a run have the same siblings above it, so the
run carries these once, and a folded hash for each leaf.

Positions come from a sort by ranges and counts of each range, so no source is
ordered in one task. For the climb, 64 runs of leaves form a chunk, and upper
nodes are stored once for each chunk below them: however large a source is, a
node's row meets 64 rows at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, sql_crc32

ARITY = 16
CHUNK = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows a recursive query may give; the default of a million is less than a table's runs.
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(row: dict[str, Column]) -> Column:
    return digest(*(_encoded(row[c]) for c in FIELDS))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered): tampered is the leaf's hash after the text's A-Z were put in lower case, where that is done."""
    row = {c: F.col(c) for c in FIELDS}
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    changed = leaf_hash({**row, "text": F.translate("text", _UPPER, _LOWER)})
    return docs.select("doc_id", "source", leaf_hash(row).alias("leaf"), F.when(chosen & F.col("text").isNotNull(), changed).alias("tampered"))


def placed(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``leaves`` with the place of their source (tree), their own place in it (pos) and the source's number of leaves (n).

    Sources ascend by bytes, null first; leaves by id, null first, then by hash.
    Rows alike in all of these are interchangeable.
    """
    kept = scratch.keep(rows)
    # the last key deals out repeated rows; the table is written, so a task that runs again numbers them alike
    ordered = kept.withColumn("many", F.monotonically_increasing_id()).repartitionByRange("source", "doc_id", "leaf", "many")
    part = scratch.keep(ordered.drop("many").withColumn("part", F.spark_partition_id()))
    # one row for each source of a range: a source's rows number no more than the ranges it lies in
    counts = part.groupBy("part", "source").agg(F.count("*").alias("n"))
    sources = counts.groupBy("source").agg(F.min("part").alias("first"), F.sum("n").alias("n"))
    inside = F.row_number().over(Window.partitionBy("first").orderBy("source"))
    sources = sources.withColumn("inside", inside)
    starts = sources.groupBy("first").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("first", before.alias("before"))  # a row for each range
    sources = sources.join(starts, "first").select("source", "n", (F.col("before") + F.col("inside") - 1).alias("tree"))
    above = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "source", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("offset"))
    same = F.col("s.source").eqNullSafe(F.col("o.source"))
    offsets = scratch.keep(offsets.alias("o").join(sources.alias("s"), same).select("o.part", "o.source", "o.offset", "s.n", "s.tree"))
    within = F.row_number().over(Window.partitionBy("part", "source").orderBy("doc_id", "leaf"))
    numbered = part.withColumn("within", within)
    both = (F.col("p.part") == F.col("o.part")) & F.col("p.source").eqNullSafe(F.col("o.source"))
    pos = (F.col("o.offset") + F.col("p.within") - 1).alias("pos")
    return numbered.alias("p").join(offsets.alias("o"), both).select("p.doc_id", "p.leaf", "p.tampered", "o.tree", pos, "o.n")


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def _power(level: int) -> int:
    return ARITY**level


def _up(level: Column, pos: Column, width: Column, tree: Column, trees: int) -> list[Column]:
    """The parent of a node of a tree whose level holds ``width`` nodes: its level above all trees (top), its level, its place, and the node's place there.

    The last node of a tree hangs in the tree above, if there are several trees; else there is no parent.
    """
    inner = width > 1
    outer = F.lit(trees > 1)
    return [
        F.when(inner, F.lit(False)).when(outer, F.lit(True)).alias("up_top"),
        F.when(inner, level + 1).when(outer, F.lit(1)).cast("int").alias("up_level"),
        F.when(inner, F.floor(pos / ARITY)).when(outer, F.floor(tree / ARITY)).cast("long").alias("up_pos"),
        F.when(inner, pos % ARITY).when(outer, tree % ARITY).cast("int").alias("up_place"),
    ]


def _parents(nodes: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """Runs of ``nodes(keys..., pos, digest)``: children's hashes in order and the run's own."""
    runs = nodes.groupBy(*keys, F.floor(F.col("pos") / ARITY).alias("pos"), *carried).agg(F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("c"))
    children = _joined(F.transform("c", lambda x: x.digest))
    return runs.select(*keys, "pos", *carried, children.alias("children"), F.sha2(children, 256).alias("digest"))


def built(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(runs, nodes) of ``placed`` rows.

    ``runs``: a row for each run of leaves, with its leaves in order and the
    link to its parent. ``nodes``: every node above, stored once for each chunk
    of runs below it (tree, chunk), with its children's hashes and its link.
    """
    item = F.struct("pos", "doc_id", "leaf", F.coalesce("tampered", "leaf").alias("tampered"))
    run = rows.groupBy("tree", "n", F.floor(F.col("pos") / ARITY).alias("pos")).agg(F.array_sort(F.collect_list(item)).alias("c"))
    own = F.transform("c", lambda x: x.leaf)
    lone = F.col("n") == 1
    run = run.select("tree", "n", "pos", "c", F.when(lone, own[0]).otherwise(F.sha2(_joined(own), 256)).alias("digest"))
    first = scratch.keep(run)
    top = first.agg(F.max("n").alias("n"), F.max("tree").alias("t")).first()
    trees = 0 if top.t is None else top.t + 1
    width = lambda level: F.ceil(F.col("n") / _power(level))
    tables, at, level = [], first.select("tree", "n", "pos", "digest"), 1
    roots = at.where("n <= 16").select("tree", "digest")
    while top.n is not None and top.n > _power(level):
        level += 1
        at = scratch.keep(_parents(at.where(width(level - 1) > 1), ["tree"], ["n"]))
        roots = roots.unionByName(at.where(width(level) == 1).select("tree", "digest"))
        span = _power(level - 1)  # runs of leaves below a node
        n_runs = F.ceil(F.col("n") / ARITY)
        chunks = F.sequence(F.floor(F.col("pos") * span / CHUNK), F.floor((F.least((F.col("pos") + 1) * span, n_runs) - 1) / CHUNK))
        up = _up(F.lit(level), F.col("pos"), width(level), F.col("tree"), trees)
        inner = at.select("tree", F.explode(chunks).alias("chunk"), F.lit(False).alias("top"), F.lit(level).alias("level"), "pos", "children", "digest", (width(level) == 1).alias("is_subroot"), *up)
        tables.append(inner)
    # the tree above: every node for each chunk of each tree below it
    chunks = first.select("tree", F.floor(F.col("pos") / CHUNK).alias("chunk")).distinct()
    outer, level, n = roots.select(F.col("tree").alias("pos"), "digest"), 0, trees
    while n > 1:
        level, n = level + 1, -(-n // ARITY)
        outer = scratch.keep(_parents(outer, [], []))
        below = chunks.withColumn("pos", F.floor(F.col("tree") / _power(level)))
        link = [F.lit(True if n > 1 else None).cast("boolean").alias("up_top"), F.lit(level + 1 if n > 1 else None).cast("int").alias("up_level"), F.floor(F.col("pos") / ARITY).alias("up_pos"), (F.col("pos") % ARITY).cast("int").alias("up_place")]
        tables.append(below.join(outer, "pos").select("tree", "chunk", F.lit(True).alias("top"), F.lit(level).alias("level"), "pos", "children", "digest", F.lit(False).alias("is_subroot"), *link))
    nodes = tables[0] if tables else _no_nodes(first)
    for more in tables[1:]:
        nodes = nodes.unionByName(more)
    leaf_up = _up(F.when(lone, 0).otherwise(1), F.col("pos"), F.when(lone, 1).otherwise(width(1)), F.col("tree"), trees)
    runs = first.select(
        "tree", F.floor(F.col("pos") / CHUNK).alias("chunk"), F.transform("c", lambda x: x.doc_id).alias("ids"), own.alias("leaves"), F.transform("c", lambda x: x.tampered).alias("tampered"),
        lone.alias("lone"), "digest", (F.col("n") <= ARITY).alias("is_subroot"), *leaf_up,
    )
    return runs, scratch.keep(nodes)


def _no_nodes(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame([], "tree long, chunk long, top boolean, level int, pos long, children string, digest string, is_subroot boolean, up_top boolean, up_level int, up_pos long, up_place int")


#: Ascends for every leaf of every run until there is no parent, at each step appending the siblings, left to right, and folding.
CLIMB = """
WITH RECURSIVE climb(tree, chunk, ids, leaves, folded, siblings, digest, subroot, top, level, pos, place) AS (
  SELECT tree, chunk, ids, leaves,
    transform(tampered, (x, i) -> CASE WHEN lone THEN x ELSE
      sha2(concat(array_join(slice(leaves, 1, i), ''), x, array_join(slice(leaves, i + 2, 16), '')), 256) END),
    CAST('' AS STRING), digest, CASE WHEN is_subroot THEN digest END, up_top, up_level, up_pos, up_place
  FROM {runs}
  UNION ALL
  SELECT c.tree, c.chunk, c.ids, c.leaves,
    transform(c.folded, x -> sha2(concat(substr(n.children, 1, 64 * c.place), x, substr(n.children, 64 * c.place + 65)), 256)),
    concat(c.siblings, substr(n.children, 1, 64 * c.place), substr(n.children, 64 * c.place + 65)),
    n.digest, CASE WHEN n.is_subroot THEN n.digest ELSE c.subroot END, n.up_top, n.up_level, n.up_pos, n.up_place
  FROM climb c JOIN {nodes} n
    ON c.tree = n.tree AND c.chunk = n.chunk AND c.top = n.top AND c.level = n.level AND c.pos = n.pos
)
SELECT * FROM climb WHERE level IS NULL
"""


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), a row for each row of ``docs``.

    A null in any column is a leaf of its own kind ("-"), empty texts have a
    length of zero. Repeated rows are leaves of their own, next to each other.
    A lone leaf has no siblings: its proof is the hash of nothing. Columns
    beside the five named are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "merkle")
    rows = placed(leaves(docs.select(*FIELDS)), scratch)
    runs, nodes = built(rows, scratch)
    before = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        done = scratch.keep(_proofs(spark.sql(CLIMB, runs=runs, nodes=nodes)))
    finally:
        if before is None:
            spark.conf.unset(ROW_LIMIT)
        else:
            spark.conf.set(ROW_LIMIT, before)
    return done


def _proofs(climbed: DataFrame) -> DataFrame:
    others = lambda i: F.concat(_joined(F.slice("leaves", F.lit(1), i)), _joined(F.slice("leaves", i + 2, F.lit(ARITY))))
    proof = F.transform("ids", lambda d, i: F.struct(d.alias("doc_id"), F.get("leaves", i).alias("leaf"), digest(others(i), F.col("siblings")).alias("proof"), F.get("folded", i).alias("folded")))
    each = climbed.select("subroot", F.col("digest").alias("root"), F.explode(proof).alias("x"))
    folded = F.col("x.folded")
    return each.select("x.doc_id", "x.leaf", "subroot", "root", F.col("x.proof").alias("proof_sha256"), folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))


def query(docs: DataFrame) -> DataFrame:
    return manifest(docs)


def _sql_leaf(text: str) -> str:
    parts = (f"CAST({text if c == 'text' else c} AS VARCHAR)" for c in FIELDS)
    return "sha256(" + " || ".join(f"coalesce(strlen({p}) || ':' || {p}, '-')" for p in parts) + ")"


_SQL_CRC = sql_crc32("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))")
_SQL_TAMPERED = _sql_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")
_SQL_LEFT, _SQL_RIGHT = "left(children, CAST(64 * (pos % 16) AS BIGINT))", "substr(children, CAST(64 * (pos % 16) + 65 AS BIGINT))"
ORACLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_sql_leaf("text")} AS leaf,
         CASE WHEN text IS NOT NULL AND doc_id IS NOT NULL AND {_SQL_CRC} % 5 = 0
              THEN {_SQL_TAMPERED} END AS tampered
  FROM documents
), l AS (
  SELECT doc_id, leaf, coalesce(tampered, leaf) AS tampered, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM d
), inner_nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS digest, n FROM l
  UNION ALL
  SELECT tree, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (n + 15) // 16 FROM inner_nodes WHERE n > 1 GROUP BY tree, level, pos // 16, n
), outer_nodes AS (
  SELECT 0 AS level, tree AS pos, digest, count(*) OVER () AS n FROM inner_nodes WHERE n = 1
  UNION ALL
  SELECT level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (n + 15) // 16 FROM outer_nodes WHERE n > 1 GROUP BY level, pos // 16, n
), inner_runs AS (
  SELECT tree, level, pos // 16 AS run, string_agg(digest, '' ORDER BY pos) AS children FROM inner_nodes GROUP BY ALL
), outer_runs AS (
  SELECT level, pos // 16 AS run, string_agg(digest, '' ORDER BY pos) AS children FROM outer_nodes GROUP BY ALL
), climb AS (
  SELECT doc_id, leaf, tree, 0 AS level, pos, n, '' AS proof, tampered AS folded FROM l
  UNION ALL
  SELECT doc_id, leaf, c.tree, c.level + 1, pos // 16, (n + 15) // 16,
         proof || {_SQL_LEFT} || {_SQL_RIGHT},
         sha256({_SQL_LEFT} || folded || {_SQL_RIGHT})
  FROM climb c JOIN inner_runs r ON c.tree = r.tree AND c.level = r.level AND c.pos // 16 = r.run WHERE n > 1
), above AS (
  SELECT doc_id, leaf, tree, 0 AS level, tree AS pos, (SELECT count(*) FROM inner_nodes WHERE n = 1) AS n, proof, folded FROM climb WHERE n = 1
  UNION ALL
  SELECT doc_id, leaf, tree, c.level + 1, pos // 16, (n + 15) // 16,
         proof || {_SQL_LEFT} || {_SQL_RIGHT},
         sha256({_SQL_LEFT} || folded || {_SQL_RIGHT})
  FROM above c JOIN outer_runs r ON c.level = r.level AND c.pos // 16 = r.run WHERE n > 1
), root AS (SELECT digest AS root FROM outer_nodes WHERE n = 1)
SELECT a.doc_id, a.leaf, s.digest AS subroot, root.root, sha256(a.proof) AS proof_sha256, a.folded AS folded_root, a.folded = root.root AS verified
FROM above a JOIN (SELECT tree, digest FROM inner_nodes WHERE n = 1) s ON a.tree = s.tree, root WHERE a.n = 1
"""
