"""Spelling variants, toxic passages and Merkle manifests, and what was mended in earlier operators."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from ledgerloom.llm import chat, html, merkle, spelling, topk, toxicity
from ledgerloom.llm.common import Scratch, table
from ledgerloom.llm.queries import QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# --- spelling ----------------------------------------------------------------


def slow_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", low(text or "")):
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(words):
    near = {w: [v for v in words if is_near(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= 5 * words[w]:
            form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words.get(form.get(w))))
    return sorted(out)


def family(seed, n=60):
    """Words and their variants, in few letters so that many are near."""
    r = random.Random(seed)
    out = {}
    for _ in range(n):
        w = "".join(r.choice("abéÀx") for _ in range(r.randrange(6, 9)))
        for _ in range(3):
            i, kind = r.randrange(len(w)), r.randrange(3)
            out[w[:i] + r.choice("abéÀx") * (kind > 0) + w[i + (kind < 2) :]] = r.choice([5, 6, 30, 200, 1000])
        out[w] = r.choice([5, 40, 300, 5000])
    return {w: k for w, k in out.items() if len(w) >= 6}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("tile", [1 << 15, 64])
def test_variants_of_words(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(spelling, "TILE", tile)
    monkeypatch.setattr(spelling, "STRIPE", 7)
    words = family(seed)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    found = spelling.grouped(df, Scratch(spark, "t")).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(tuple(r) for r in found) == slow_variants(words)


def test_words_are_counted_over_documents(spark, monkeypatch):
    monkeypatch.setattr(spelling, "STEP", 10)
    monkeypatch.setattr(spelling, "HELD", 5)
    r = random.Random(3)
    vocabulary = ["straße", "Straße", "ÄRGERnis", "wörter-buch", "häufig×es", "abc", "x" * 40, "lettersö", "words2words"]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(40))) for i in range(150)] + [(7, None), (None, "lettersö " * 9), (None, None), (3, ""), (5, "...")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.word: r.n for r in spelling.counted(df).collect()}
    assert got == slow_words(rows) and any(len(w) in (39, 7) and w not in {low(v) for v in vocabulary} for w in got)


@pytest.mark.parametrize("a, b, want", [("abcdef", "abcdeg", 1), ("abcdef", "abcdef", 0), ("abcdef", "bacdef", 0), ("aaaaaa", "aaaaaaa", 1), ("abcdef", "xabcdef", 1), ("abcdef", "abcdefx", 1), ("abcdef", "abxcdxf", 0), ("aabbaa", "abbaa", 1)])
def test_one_edit(a, b, want):
    for x, y in ((a, b), (b, a)):
        i, j = spelling.near_pairs([x], [y], False)
        assert len(i) == len(j) == want


def test_blocks_of_near_words_are_adjacent(spark):
    words = list(family(5, 40))
    block = {r.word: tuple(r.b) for r in spark.createDataFrame([(w,) for w in words], "word string").select("word", spelling.block(spelling.F.col("word")).alias("b")).collect()}
    moves = {tuple(m) for m in spelling.neighbours()} | {tuple(-x for x in m) for m in spelling.neighbours()}
    assert len(moves) == 2 * len(spelling.neighbours()) - 1
    for w in words:
        assert sum(block[w]) == len(w)
        assert all(tuple(np.subtract(block[v], block[w])) in moves for v in words if is_near(w, v))


def test_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string, word string, n int")).collect() == []
    lone = spark.createDataFrame([(1, "single " * 6)], "doc_id long, text string")
    assert [tuple(r) for r in spelling.variants(lone).collect()] == [("single", None, "single", 6, 0, None)]


# --- toxicity ----------------------------------------------------------------


def slow_segments(s):
    """Maximal segments by their definition: the best of the whole, then of what lies on its sides."""
    best = max(((sum(s[i:j]), -(j - i), i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=None)
    if best is None or best[0] <= 0:
        return []
    _, _, i, j = best
    return slow_segments(s[:i]) + [(i, j, best[0])] + [(a + j, b + j, x) for a, b, x in slow_segments(s[j:])]


@pytest.mark.parametrize("seed", range(40))
def test_segments(seed):
    r = random.Random(seed)
    s = [r.choice([-3, -2, -1, 1, 2, 4]) + r.random() / 1000 for _ in range(r.randrange(0, 24))]
    got = toxicity.segments(np.array(s))
    want = slow_segments(s)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert np.allclose([x for *_, x in got], [x for *_, x in want])


def test_segments_are_linear():
    import time

    for s in (np.tile([1.0, -0.5], 100_000), np.tile([1.0, -2.0], 100_000), np.concatenate([np.arange(100_000, 0, -1) * -1.0 + 0.0, np.ones(100_000)])):
        began = time.monotonic()
        toxicity.segments(s)
        assert time.monotonic() - began < 3


def test_log_odds_draw_in_what_is_rare():
    toxic, clean = np.array([40.0, 1, 0, 20, 0]), np.array([0.0, 0, 1, 900, 0])
    odds = toxicity.log_odds(toxic, clean, 100, 900)
    assert odds[0] > 2 and odds[1] == odds[2] == odds[4] == 0 and odds[3] < 0


def test_sum_statistic_grows_with_passages():
    one, two = (toxicity.sum_statistic([6.0] * k, 200, 1.3, 0.01) for k in (1, 2))
    assert 0 < one < two and toxicity.sum_statistic([], 200, 1.3, 0.01) == toxicity.sum_statistic([0.1], 10**6, 1.3, 1.0) == 0
    assert toxicity.sum_statistic([6.0], 20_000, 1.3, 0.01) < one


@pytest.fixture(scope="module")
def planted(spark):
    """Clean texts of 400 invented words, and toxic ones with a passage of ten others somewhere."""
    r = random.Random(11)
    vocabulary, bad = [f"word{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"], ["vilest", "grimly", "foulest", "nastier"]
    docs, labels = [], []
    for i in range(600):
        ws = [r.choice(vocabulary) for _ in range(r.randrange(5, 200))]
        toxic = i % 6 == 0
        if toxic:
            at = r.randrange(len(ws))
            ws[at:at] = [r.choice(bad) for _ in range(5)]
        docs.append((i, " ".join(ws)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_planted_passages_are_found(spark, planted):
    docs, labels = planted
    model = toxicity.train(docs, labels)
    more = docs.unionByName(spark.createDataFrame([(None, None), (1000, ""), (1001, "the " * 5), (None, "vilest foulest")], "doc_id long, text string"))
    rows = toxicity.scored(more, model, passages=True).collect()
    assert len(rows) == 604
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    told = [(i, p, set(by_id[i].text[p.start : p.stop].split()) & {"vilest", "grimly", "foulest", "nastier"}) for i in range(600) for p in by_id[i].passages]
    assert all((by_id[i].score >= 0.3) == (i % 6 == 0) for i in range(600))
    assert {i for i, _, bad in told if bad} == set(range(0, 600, 6)) and all(p.expected < toxicity.SIGNIFICANT for _, p, _ in told)
    assert sum(not bad for *_, bad in told) < 0.1 * len(told)  # a few words of 100 lean to a side by chance
    assert by_id[1000].score < 0.3 and by_id[1001].score < 0.3 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.scored(docs.limit(0), model).collect() == []


def test_pieces_change_nothing(planted, monkeypatch):
    docs, labels = planted
    model = toxicity.train(docs, labels)
    text = " ".join(r.text for r in docs.limit(40).collect())
    whole = model.found(text)
    passages = model.significant(text, *whole)
    monkeypatch.setattr(toxicity, "STEP", 17)
    assert model.found(text) == whole and passages and all(text[a:b].strip() == text[a:b] for a, b, *_ in passages)


def test_labels_of_held_out_rows_are_not_read(spark, planted):
    docs, labels = planted
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a, b = (toxicity.query(docs, x).orderBy("doc_id").collect() for x in (labels, turned))
    assert a == b and {r.doc_id for r in a if r.held_out} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2}


def test_without_labels_of_both_kinds(spark, planted):
    docs, labels = planted
    for some in (labels.where("toxic = 0"), labels.limit(0), labels.where("toxic = 1")):
        scores = {r.score for r in toxicity.query(docs, some).collect()}
        assert len(scores) == 1 and all(math.isfinite(s) for s in scores)


@needs_data
def test_accuracy_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01" if os.path.isdir("/root/testdata/sf0.01") else DATA
    found = QUERIES["op12_toxicity"](spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").select("predicted", "toxic").collect()
    right = sum(r.predicted == r.toxic for r in found)
    toxic = [r for r in found if r.toxic]
    assert right / len(found) > 0.9 and sum(r.predicted for r in toxic) / len(toxic) > 0.6


# --- Merkle ------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_leaf(row, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, place):
    out = []
    for level in tree[:-1]:
        first = place // 16 * 16
        out.append((level[first:place], level[place + 1 : first + 16]))
        place //= 16
    return out


def slow_manifest(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, slow_leaf(r, r[4])))
        trees[s] = levels([slow_leaf(r, r[4]) for r in by_source[s]])
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for t, s in enumerate(sources):
        for p, r in enumerate(by_source[s]):
            proof, leaf = siblings(trees[s], p) + siblings(top, t), trees[s][0][p]
            chosen = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            folded = slow_leaf(r, low(r[4])) if chosen else leaf
            for left, right in proof:
                folded = H(*left, folded, *right)
            root = top[-1][0]
            out.append((r[0], leaf, trees[s][-1][0], root, H(*(x for pair in proof for side in pair for x in side)), folded, folded == root))
    return sorted(out, key=repr)


ROWS = "doc_id long, source string, lang string, n_chars long, text string"


def manifest_rows(sizes, seed=0):
    r = random.Random(seed)
    return [(k * 1000 + i, s, r.choice(["en", None]), r.choice([i, None]), r.choice(["Text É %d" % i, "UPPER", "", None])) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]


@pytest.mark.parametrize(
    "sizes",
    [{"a": 1}, {"a": 16}, {"a": 17}, {"a": 257}, {"a": 1, "b": 1}, {None: 3, "": 2, "é": 20, "z": 1, "Z": 16}, {f"s{k}": k % 3 + 1 for k in range(40)}, {**{f"s{k}": 1 for k in range(300)}, "hot": 700}],
)
def test_manifest(spark, monkeypatch, sizes):
    monkeypatch.setattr(merkle, "CHUNK", 4)
    rows = manifest_rows(sizes)
    df = spark.createDataFrame(rows, ROWS).repartition(3).withColumn("root", merkle.F.lit("clash"))
    assert sorted((tuple(r) for r in merkle.manifest(df).collect()), key=repr) == slow_manifest(rows)


def test_manifest_of_ties_and_nulls(spark):
    rows = manifest_rows({"a": 20})
    rows = rows * 2 + [(5, "a", "en", 1, "other"), (None, "a", None, None, None), (None, "a", None, None, "X"), (None, None, None, None, None), (-3, "a", "en", 2, "y")]
    found = merkle.manifest(spark.createDataFrame(rows, ROWS).repartition(3))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == slow_manifest(rows)
    assert merkle.manifest(spark.createDataFrame([], ROWS)).collect() == []


# --- mended ------------------------------------------------------------------


def shape(rows):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in rows)


def slow_topk(rows):
    """By whole numbers, scores held at the limits of a long."""
    q = {i: [math.floor(1024 * x) for x in v] for i, v in rows if v is not None and None not in v and all(math.isfinite(x) for x in v)}
    out = []
    for i in (i for i in q if i % 100 == 0):
        scores = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q[i], q[j], strict=True)))), j) for j in q if j != i and len(q[j]) == len(q[i])]
        out += [(i, k, j, s) for k, (s, j) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:10], 1)]
    return sorted(out)


def test_topk_keeps_wide_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [70000.0, -1.0]), (2, [0.5, 0.5]), (100, [100000.0, 3.0])], "vec_id long, embedding array<double>")
    got = shape(topk.query(df).collect())
    assert {(r[0], r[2]) for r in got} == {(0, 1), (0, 2), (0, 100), (100, 0), (100, 1), (100, 2)}
    con = duckdb.connect()
    con.register("embeddings", df.toPandas())
    assert got == sorted(con.sql(topk.ORACLE_SQL).select("query_id, rank, vec_id, score").fetchall())


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e12, 1e30, 1e300])
def test_topk_of_any_size(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "ROWS", 64)
    monkeypatch.setattr(topk, "FIRST", 3)
    r = random.Random(int(math.log10(scale)))
    rows = [(i, [r.gauss(0, 1) * (scale if r.random() < 0.3 else 1.0) for _ in range(4)]) for i in range(300)]
    rows += [(700, rows[0][1]), (701, rows[0][1]), (800, []), (801, []), (802, None), (803, [math.nan] * 4), (804, [None] * 4), (900, [0.0] * 4), (-100, [-scale] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert shape(topk.query(df).collect()) == slow_topk(rows)


def test_ties_of_turns_with_marks(spark):
    rows = [(1, 0, "a", "<a first"), (1, 0, "a", "<|b second"), (1, 0, "b", "|> x"), (1, 0, "b", "|a"), (1, 1, "a", "end")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    mine = chat.query(df)
    theirs = con.sql(chat.ORACLE_SQL)
    key = lambda r: (r[0], r[2])
    assert sorted((tuple(r) for r in mine.select(*theirs.columns).collect()), key=key) == sorted(theirs.fetchall(), key=key)
    assert mine.first().rendered.index("<a first") < mine.first().rendered.index("<\\|b second")


@pytest.mark.parametrize("part, stays", [
    ('<section id="cookies"><p>bake them</p></section>', True), ('<div class="modal-verbs"><p>bake them</p></div>', True), ('<div class="widget-history"><p>bake them</p></div>', True), ('<h2 id="related">bake them</h2>', True), ('<h2 id="comments">bake them</h2>', True),
    ('<p>then <span class="alert">bake them</span> now</p>', True), ('<div class="ad">bake them</div>', False), ('<div class="newsletter-signup">bake them</div>', False), ('<p><span class="ad">bake them</span></p>', False), ('<div id="comments">bake them</div>', False), ('<section class="comments"><p>bake them</p></section>', False),
    ('<div class="cookie-notice">bake them</div>', False), ("<aside><p>bake them</p></aside>", False),
])
def test_names_in_articles(spark, part, stays):
    page = f"<html><body><nav>menu</nav><article><h1>Title</h1><p>{'word ' * 60}</p>{part}<p>{'more ' * 60}</p></article><footer>end</footer></body></html>"
    text = html.main_text(spark.createDataFrame([(1, "http://h/x", page)], "page_id long, url string, html string")).first().text
    assert ("bake them" in text) == stays and text.startswith("Title") and text.rstrip().endswith("more") and "menu" not in text


@pytest.mark.parametrize("unit", ['<a x=">" ', "<a x='>\" y=\">' ", '<a x=">\' ', "<b c='\">' d=\" "])
def test_quoted_ends_of_tags_are_linear(unit):
    import time

    began = time.monotonic()
    html.parse(unit * ((1 << 20) // len(unit)))
    assert time.monotonic() - began < 4
