"""Line-first cleaning with built-in functions only.

Rules for punctuation (symbols included), navigation and boilerplate are evaluated per line,
failing lines are removed, and a document that loses too much of its text is
rejected. Everything is a projection of the scan: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: A line is navigation if it has so many separators between so few characters; short lines also by trail marks and first words.
NAVIGATION = r"^[^|]{0,24}\|[^|]{0,24}\|([^|]{0,24}\|){2}"
MENU = r"[»›]|^(?:Home|Menu|Skip to content|Next|Previous)\b"
BOILERPLATE = r"(?i)\b(?:cookies?|privacy policy|terms of (?:use|service)|all rights reserved|licensed under|subscribe|newsletter|enable javascript|sign in|log in|click here|copyright)\b|©"
#: Endings of a sentence, also inside closing quotes or brackets.
SENTENCE_END = r"[.!?:;…。！？][\"'”’»)\]]*[\x20\x09-\x0D]*$"
#: A line without an ending passes if it is at most this long (headings, broken lines).
HEADING_WORDS = 12
#: Finds a line of more words than that, by its runs of white space.
LONG_LINE = rf"^(?:[^\x20\x09-\x0D]*+[\x20\x09-\x0D]++){{{HEADING_WORDS}}}"
#: Symbols that a line may hold of 100 characters.
MOST_SYMBOLS = 10
#: Share of a document's word characters that failing lines may hold.
MOST_LOST = 0.5
LEAST_WORDS, MOST_REPEATED = 50, 50


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def line_fails(line: Column) -> Column:
    """The first rule that a line fails, or null. Cheap conditions stand first: they spare the others."""
    long_line = line.rlike(LONG_LINE)
    return (
        F.when(line.rlike(NAVIGATION) | (~long_line & line.rlike(MENU)), "navigation")
        .when(~long_line & line.rlike(BOILERPLATE), "boilerplate")
        .when(line.rlike(f"[{SYMBOLS}]") & (100 * (F.length(line) - _without(line, SYMBOLS)) > MOST_SYMBOLS * F.length(line)), "punctuation")
        .when(long_line & ~line.rlike(SENTENCE_END), "punctuation")
    )


def measure(docs: DataFrame) -> DataFrame:
    """Adds the counts, ``cleaned`` (the text without failing lines) and the verdicts.

    Null and empty texts have no word: all counts are 0, base_failed is true and
    kept false. A text without word characters loses nothing. Repeated rows,
    null ids and other columns pass through; columns of ``docs`` that clash
    with a result's name are replaced.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    base = docs.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    base = base.withColumns({
        "_words": F.array_remove(F.split(text, SPACE), ""),
        "_lines": F.split(text, "\n"),
    })
    base = base.withColumns({
        "n_words": F.size("_words").cast("long"),
        "_full": F.filter("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "_good": F.filter("_lines", lambda x: line_fails(x).isNull()),
        # every three-word window by hash; null in texts of fewer words
        "_hashes": F.when(
            F.size("_words") >= 3,
            F.slice(F.transform("_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))), F.lit(1), F.size("_words") - 2),
        ),
    })
    # with their places, in order; null where no window comes again, which needs no sorting
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    base = base.withColumn("_tri", F.when(repeats, F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    before = lambda x, k: F.when(k > 0, x["h"] == F.get("_tri", k - 1)["h"]).otherwise(False)
    after = lambda x, k: F.coalesce(x["h"] == F.get("_tri", k + 1)["h"], F.lit(False))
    again = F.transform("_tri", lambda x, k: F.when(before(x, k) | after(x, k), x["i"]))
    base = base.withColumn("_again", F.sort_array(F.filter(again, lambda i: i.isNotNull())))
    covered = F.aggregate(
        "_again",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
    )["n"]
    base = base.withColumns({
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "cleaned": F.array_join("_good", "\n"),
    })
    base = base.withColumn("kept_chars", F.length(F.regexp_replace("cleaned", SPACE, "")).cast("long"))
    base = base.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    lost = (F.col("word_chars") - F.col("kept_chars")) > MOST_LOST * F.col("word_chars")
    base = base.withColumn("kept", ~F.col("base_failed") & ~lost)
    return base.drop("_text", "_words", "_lines", "_full", "_good", "_hashes", "_tri", "_again")


def query(docs: DataFrame) -> DataFrame:
    return measure(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_string(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), tri AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM tri) WHERE c >= 2
), rep AS (
  SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + j AS p FROM again, (SELECT unnest([0, 1, 2]) AS j)) GROUP BY rid
), line AS (
  SELECT rid, l, length(regexp_replace(l, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars,
         len(regexp_split_to_array(l, '[\\x20\\x09-\\x0D]+')) > {HEADING_WORDS} AS long_line
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d)
), lines AS (
  SELECT rid, count(*) FILTER (chars > 0) - count(DISTINCT l) FILTER (chars > 0) AS dup,
         coalesce(sum(chars) FILTER (NOT (regexp_matches(l, {_sql_string(NAVIGATION)})
           OR (regexp_matches(l, {_sql_string(MENU)}) AND NOT long_line)
           OR (regexp_matches(l, {_sql_string(BOILERPLATE)}) AND NOT long_line)
           OR 100 * length(regexp_replace(l, '[^#*$%&|<>]', '', 'g')) > {MOST_SYMBOLS} * length(l)
           OR (long_line AND NOT regexp_matches(l, {_sql_string(SENTENCE_END)})))), 0) AS kept_chars
  FROM line GROUP BY rid
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, kept_chars
  FROM d LEFT JOIN lines USING (rid) LEFT JOIN rep USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
       NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words)
         AND NOT (word_chars - kept_chars > {MOST_LOST} * word_chars) AS kept
FROM m
"""
