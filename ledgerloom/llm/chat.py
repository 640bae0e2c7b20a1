"""Multi-party chat formatting by perspective rotation, with built-in functions only.

For every participant of a dialogue one row is rendered in which this speaker
is the assistant and the others are users with their names; the mask marks the
text that the assistant says. System turns belong to nobody and are rendered
as such in every perspective.

Rotation happens after the turns are brought together, inside the row. Rows
hold ``SEGMENT_TURNS`` turns at most, counted by position and not by turn
number, so that no group grows without bound: a longer dialogue has several
rows for each of its participants, silent or not, which joined in order are its
whole rendering; their offsets run on through it. Positions come from counts of
ranges of turn numbers and the place in a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT_TURNS = 1024
SYSTEM, UNNAMED = "system", "unknown"
OPEN, CLOSE = "<|", "|>\n"
END = "<|end|>\n"
#: Marks in texts and roles are broken up, so that none but those put here counts.
ESCAPES = (("<|", "<\\|"), ("|>", "|\\>"))


def _escaped(c: Column) -> Column:
    for mark, other in ESCAPES:
        c = F.replace(c, F.lit(mark), F.lit(other))
    return c


def _head(role: Column, perspective: Column | None = None) -> Column:
    """What stands before a turn; without a perspective, as others see it."""
    user = F.concat(F.lit(f"{OPEN}user name="), F.translate(_escaped(role), "\r\n", "  "), F.lit(CLOSE))
    head = F.when(role == SYSTEM, F.lit(f"{OPEN}system{CLOSE}"))
    if perspective is not None:
        head = head.when(role == perspective, F.lit(f"{OPEN}assistant{CLOSE}"))
    return head.otherwise(user)


def render(turns: DataFrame, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """(conv_id, segment, perspective, offset, n_turns, rendered, mask array<struct<start, end>>) for ``turns(conv_id, turn, role, text)``.

    ``mask`` holds the code points of ``rendered`` that are learned from: the
    assistant's texts with their end mark. ``offset`` is the code points of the
    dialogue's whole rendering before this segment. Turns are ordered by turn,
    role and text; ties and repeated rows are rendered each. A null or empty
    role counts as the participant "unknown", a null text as empty, a null turn
    as before all others, and null conv_ids as one dialogue. A dialogue with
    system turns only has no participant and no row; an empty table gives no
    rows; other columns are ignored. ``<|`` and ``|>`` in texts and roles get a
    backslash in between, line ends in shown roles become blanks.
    """
    role = F.when(F.coalesce(F.trim("role"), F.lit("")) == "", UNNAMED).otherwise(F.col("role"))
    # in a struct a null conv_id is a key like any other
    rows = turns.select(F.struct("conv_id").alias("conv"), "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.struct(F.floor(F.col("turn") / segment_turns).alias("n")).alias("range"))
    counts = rows.groupBy("conv", "range").agg(F.count("*").alias("n"))
    so_far = Window.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(so_far.partitionBy("conv").orderBy("range")), F.lit(0))
    place = F.row_number().over(Window.partitionBy("conv", "range").orderBy("turn", "role", "text")) - 1
    placed = rows.withColumn("place", place).join(counts.select("conv", "range", before.alias("before")), ["conv", "range"])
    at = F.col("before") + F.col("place")
    segment = F.floor(at / segment_turns).cast("long")
    placed = placed.select("conv", segment.alias("segment"), at.alias("at"), "role", _escaped(F.col("text")).alias("text"))
    # by place, which is of the texts as they were: marks change their order
    grouped = placed.groupBy("conv", "segment").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text"))).alias("turns"))

    # who sees which segment, and what is rendered before it; only dialogues of several segments need sums
    names = rows.where(F.col("role") != SYSTEM).select("conv", F.col("role").alias("perspective")).distinct()
    long = placed.where("segment > 0").select("conv").distinct()
    n_chars = F.length("text") + F.length(F.lit(END)) + F.length(_head(F.col("role")))
    parts = placed.join(long, "conv", "left_semi").groupBy("conv", "segment", "role").agg(F.sum(n_chars).alias("chars"), F.count("*").alias("n"))
    whole = parts.groupBy("conv", "segment").agg(F.sum("chars").alias("chars"))
    own = parts.select("conv", "segment", F.col("role").alias("perspective"), "n")
    less = F.length(_head(F.col("perspective"))) - len(f"{OPEN}assistant{CLOSE}")
    seen = whole.join(names, "conv").join(own, ["conv", "segment", "perspective"], "left").withColumn("chars", F.col("chars") - F.coalesce("n", F.lit(0)) * less)
    offset = F.coalesce(F.sum("chars").over(so_far.partitionBy("conv", "perspective").orderBy("segment")), F.lit(0)).cast("long")
    later = seen.select("conv", "segment", "perspective", offset.alias("offset")).where("segment > 0")
    first = names.select("conv", F.lit(0).cast("long").alias("segment"), "perspective", F.lit(0).cast("long").alias("offset"))
    rotated = grouped.join(first.unionByName(later), ["conv", "segment"])

    mine = lambda t: t["role"] == F.col("perspective")
    piece = lambda t: F.struct(_head(t["role"], F.col("perspective")).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), mine(t).alias("mine"))
    pieces = rotated.withColumn("pieces", F.transform("turns", piece))
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: long, end: long>>").alias("found")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"])).alias("at"),
            F.when(
                p["mine"],
                F.concat(acc["found"], F.array(F.struct((acc["at"] + F.length(p["head"])).alias("start"), (acc["at"] + F.length(p["head"]) + F.length(p["body"])).alias("end")))),
            ).otherwise(acc["found"]).alias("found"),
        ),
    )["found"]
    return pieces.select(
        "conv.conv_id", "segment", "perspective", "offset", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"),
        spans.alias("mask"),
    )


def query(turns: DataFrame) -> DataFrame:
    found = render(turns)
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"], m["end"])), ",")
    return found.select("conv_id", "segment", "perspective", "offset", "n_turns", "rendered", mask.alias("mask"), F.length("rendered").cast("long").alias("n_chars"))


def _sql_escaped(c: str) -> str:
    for mark, other in ESCAPES:
        c = f"replace({c}, '{mark}', '{other}')"
    return c


ORACLE_SQL = f"""
WITH t AS (
  SELECT row_number() OVER () AS rid, conv_id, turn,
         CASE WHEN coalesce(trim(role), '') = '' THEN '{UNNAMED}' ELSE role END AS role, coalesce(text, '') AS text
  FROM conversations
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, rid) AS place FROM t
), p AS (
  SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> '{SYSTEM}'
), x AS (
  SELECT o.conv_id, place, (place - 1) // {SEGMENT_TURNS} AS segment, role, perspective,
         CASE WHEN role = '{SYSTEM}' THEN '<|system|>' || chr(10) WHEN role = perspective THEN '<|assistant|>' || chr(10)
              ELSE '<|user name=' || translate({_sql_escaped('role')}, chr(13) || chr(10), '  ') || '|>' || chr(10) END AS head,
         {_sql_escaped('text')} || '<|end|>' || chr(10) AS body
  FROM o JOIN p ON o.conv_id IS NOT DISTINCT FROM p.conv_id
), y AS (
  SELECT *, CAST(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective ORDER BY place) AS BIGINT) AS stop FROM x
), z AS (
  SELECT *, min(stop - length(head) - length(body)) OVER (PARTITION BY conv_id, perspective, segment) AS start FROM y
)
SELECT conv_id, CAST(segment AS BIGINT) AS segment, perspective, min(start) AS "offset", count(*) AS n_turns,
       string_agg(head || body, '' ORDER BY place) AS rendered,
       coalesce(string_agg(stop - start - length(body) || ':' || stop - start, ',' ORDER BY place) FILTER (role = perspective), '') AS mask,
       CAST(sum(length(head) + length(body)) AS BIGINT) AS n_chars
FROM z GROUP BY conv_id, segment, perspective
"""
