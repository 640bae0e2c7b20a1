"""What the findings of the third round were about."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.llm import quality_rules, simhash, suffix


def test_quality_rules_split_no_line_and_sort_only_repeated_windows(spark):
    lines = ["", " ", "a", "\t" + "a " * 12, "a " * 11 + "a", "a " * 12 + "a", " lead" * 12, "a\x0b\x0c b " * 6, "é\x85日 " * 13]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    long_line = F.col("text").rlike(quality_rules.LONG_LINE)
    by_parts = F.size(F.split("text", quality_rules.SPACE)) > quality_rules.HEADING_WORDS
    assert docs.where(long_line != by_parts).count() == 0 and 0 < docs.where(long_line).count() < len(lines)
    plan = quality_rules.query(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(_text") == 2 and "split(lambda" not in plan  # words and lines
    got = quality_rules.measure(spark.createDataFrame([(1, "a b c d e"), (2, "a b c d a b c")], "doc_id long, text string"))
    assert {x.doc_id: x.n_repeat_words for x in got.collect()} == {1: 0, 2: 6}


def test_suffix_sorts_each_segment_of_a_part_once(monkeypatch):
    r = np.random.default_rng(3)
    texts = [r.integers(97, 123, 60 + k, np.uint8).tobytes() for k in range(12)]
    sent = [(7, [0, 1, 2, 3]), (3, [0, 1, 4, 5]), (9, [0, 2, 4, 6])]  # a document for each chunk
    rows = []
    for chunk, (doc, which) in enumerate(sent):
        n = len(which)
        pieces = [texts[k] for k in which]
        alias = np.array([[0, 5]], np.int64) if chunk == 2 else np.zeros((0, 2), np.int64)  # the first segment is also at 1000 of the document 5
        rows.append({
            "part": 0, "chunk": chunk, "doc": np.full(n, doc).tobytes(), "local": np.full(n, chunk).tobytes(), "start": np.arange(0, 200 * n, 200).tobytes(),
            "windows": np.array([len(p) - 49 for p in pieces], np.uint8).tobytes(), "bytes": b"".join(pieces), "alias": alias.tobytes(), "alias_start": np.array([1000] * len(alias), np.int64).tobytes(), "stop": b"",
        })
    sizes, sort = [], suffix.suffix_array
    monkeypatch.setattr(suffix, "suffix_array", lambda s, *a: sizes.append(len(s)) or sort(s, *a))
    got = set()
    for x in suffix._sort_part(pa.Table.from_pylist(rows)).to_pylist():
        got |= {(x["chunk"], *map(int, y)) for y in zip(*(np.frombuffer(x[k], np.int64) for k in ("local", "start", "stop")), strict=True)}
    least = {k: min(doc for doc, which in sent if k in which) for _, which in sent for k in which}
    want = {(c, c, 200 * i, 200 * i + len(texts[k])) for c, (doc, which) in enumerate(sent) for i, k in enumerate(which) if doc > least[k]}
    assert got == want | {(2, 5, 1000, 1060)}
    assert sizes[0] == sum(len(texts[k]) + 1 for k in least)  # before: each as often as it was sent


def test_edits_of_one_text_make_no_pairs_of_their_copies(spark, monkeypatch):
    """Outsiders of a class are not measured against all its texts, and those that are similar to one of them are found."""
    r = random.Random(21)
    base = [f"w{r.randrange(5000)}" for _ in range(160)]

    def edited(ws, n, tag):
        out = list(ws)
        for k, at in enumerate(r.sample(range(0, len(ws) // 6), n)):
            out[6 * at + 2] = f"{tag}x{k}"
        return out

    rows = [(0, base)] + [(1 + k, edited(base, 2, f"c{k}")) for k in range(250)]  # similar to the base
    rows += [(1000 + k, edited(base, 6, f"o{k}")) for k in range(150)]  # to none
    rows += [(2000 + k, edited(rows[1 + k][1], 3, f"l{k}")) for k in range(40)]  # to one copy, mostly not to the base
    rows += [(3000 + k, edited(base[: 148 - k], 0, "")) for k in range(3)] + [(3100 + k, base[: 124 - k]) for k in range(3)]  # cut short, to one another
    rows += [(4000, base[:60] + base[76:]), (4100, base[:60] + [f"new{k}" for k in range(16)] + base[76:])]  # without a passage, and with another in its place
    sets = {i: {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} for i, ws in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and alike(a, b) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    measured, verified = [], simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda pairs, *a: measured.append(pairs.where("a != b").distinct().count()) or verified(pairs, *a))
    got = {x.doc_id: x.component_id for x in simhash.similar(spark.createDataFrame([(i, " ".join(ws)) for i, ws in rows], "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in sets}
    assert sum(find(i) == i for i in sets) >= 100 and sum(measured) < 20 * len(rows)


def test_outsiders_of_a_class_make_no_pairs_of_their_meetings(spark, monkeypatch):
    """Edits of one text that are similar neither to it nor to each other meet everywhere, with some edits in common; few pairs of them are measured."""
    r = random.Random(5)
    base = [f"w{r.randrange(5000)}" for _ in range(160)]

    def edited(n, tag, words):
        out = list(base)
        for k, at in enumerate(r.sample(range(26), n)):
            out[6 * at + 2] = f"{tag}{k}" if words is None else f"e{r.randrange(words)}"
        return out

    rows = [(0, base)] + [(1 + k, edited(2, f"c{k}x", None)) for k in range(60)]  # similar to the base
    rows += [(1000 + k, edited(5, "", 2)) for k in range(500)]  # at 26 places one of two words
    sets = {i: {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} for i, ws in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and alike(a, b) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    measured, verified = [], simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda pairs, *a: measured.append(pairs.where("a != b").distinct().count()) or verified(pairs, *a))
    got = {x.doc_id: x.component_id for x in simhash.similar(spark.createDataFrame([(i, " ".join(ws)) for i, ws in rows], "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in sets}
    assert sum(find(i) == i for i in sets) >= 100 and sum(measured) < 40 * len(rows)
