"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator over documents."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import chat, classifier, html, mixing, packing, quality_rules, secrets, simhash, suffix, topk

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "word another third fourth. " * 20_000
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again in the old town of the north", "en", "a", 10),
    (1, "the quick brown fox jumps over the lazy dog again and again in the old town of the north", "en", "a", 10),
    (2, "the quick brown fox jumps over the lazy dog again and again in the old town of the north", None, None, None),
    (3, None, "en", "a", 0), (4, "", "en", "a", 0), (None, "password = abcdef123 and more", "en", "a", 5), (None, None, None, None, None), (5, " \n\t ", "en", "b", 4), (6, LONG, "en", "b", len(LONG)), (7, "é\u0000x 漢字 \U0001f600", "xx", "b", 8),
]
CLASH = ["score", "sha", "chunk", "spans", "fp", "root", "rate", "copies", "label", "n_words", "kept", "_text", "h", "part", "n_tokens", "size", "least", "path", "host"]


@pytest.fixture(scope="module")
def docs(spark):
    found = spark.createDataFrame(ROWS, DDL)
    return found.withColumns({c: F.lit(1) for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 0, 1), (4, None, None), (None, 1, 0), (6, 1, 0), (6, 0, 0)], "doc_id bigint, quality int, toxic int")


def runs(labels):
    return {
        "simhash": simhash.query, "suffix": suffix.query, "secrets": secrets.query, "rules": quality_rules.query,
        "classifier": lambda d: classifier.query(d, labels), "mixing": lambda d: mixing.query(d, labels),
    }


@pytest.mark.parametrize("name", ["simhash", "suffix", "secrets", "rules", "classifier", "mixing"])
def test_documents(docs, labels, name):
    run = runs(labels)[name]
    got = run(docs).collect()
    assert len(got) == len(ROWS)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    twice = [r for r in got if r.doc_id == 1]
    assert twice[0] == twice[1]
    assert run(docs.limit(0)).collect() == []


def test_whole_operators_with_clashing_columns(docs, labels):
    assert len(quality_rules.measure(docs).collect()) == len(ROWS)
    assert len(mixing.mix(docs, labels).collect()) == len(ROWS)
    assert len(classifier.scored(docs, classifier.train(docs, labels)).collect()) == len(ROWS)
    assert len(secrets.scan(docs, keep=("doc_id", "text", "n_chars", "root"), mark="[{kind}]").collect()) == len(ROWS)
    assert len(suffix.remove_repeats(docs).collect()) == len(ROWS)


def test_empty_labels(docs, labels):
    assert len(classifier.query(docs, labels.limit(0)).collect()) == len(ROWS)
    assert len(mixing.query(docs, labels.limit(0)).collect()) == len(ROWS)


def test_packing(docs):
    got = packing.pack(docs).collect()
    whole = {}
    for r in got:
        whole.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    assert sum(r.length for r in got if r.doc_id == 4) == 1
    for (_, n), parts in whole.items():
        assert sum(x for _, x in parts) % n == 0
    assert packing.pack(docs.limit(0)).collect() == []


def test_pages(spark):
    rows = [(1, "http://a/x", "<article><p>one &amp; two</p></article>"), (1, "http://a/x", "<article><p>one &amp; two</p></article>"), (2, None, None), (3, "no url", ""), (None, "http://a/y", "<p>only <b>this"), (4, "http://a/z", "<" * 3000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit(1) for c in ("host", "path", "text", "score", "n")})
    got = html.query(pages).collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    assert texts[1] == "one & two" and texts[2] == "" and texts[3] == "" and texts[None] == "only this"
    assert html.query(pages.limit(0)).collect() == []


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, -0.25]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (None, [1.0, 1.0]), (100, [-1.0, 0.5]), (8, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({c: F.lit(1) for c in ("q", "rb", "qb", "dims", "rank")})
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.query(df).collect()]
    assert sorted(x for x in got if x[0] == 0) == [(0, 1, 1, 1024 * 1024), (0, 2, 1, 1024 * 1024), (0, 3, 2, 512 * 1024), (0, 4, 100, -1024 * 1024)]
    assert len([x for x in got if x[0] == 100]) == 4
    assert topk.query(df.limit(0)).collect() == []


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "ann", None), (1, None, None, "x"), (None, 0, "user", "y"), (2, 0, "system", "rule"), (3, 5000, "", "far")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({c: F.lit(1) for c in ("turns", "segment", "perspective", "pieces", "mask")})
    got = {(r.conv_id, r.perspective): r for r in chat.render(df).collect()}
    assert set(got) == {(1, "ann"), (1, "unknown"), (1, "user"), (None, "user"), (3, "unknown")}
    r = got[1, "user"]
    assert [r.rendered[m.start : m.end] for m in r["mask"]] == ["hi<|end|>\n"] * 2
    assert r.rendered.startswith("<|user name=unknown|>\nx<|end|>\n<|assistant|>\nhi")
    assert chat.render(df.limit(0)).collect() == []


def test_chat_keeps_long_dialogues_whole(spark):
    """Every participant has every segment; segments are counted by position, whatever the turn numbers are."""
    from ledgerloom.llm import chat

    long = [("long", i, "system" if i == 0 else "a" if i < 12 else "b", f"t{i}") for i in range(20)]
    sparse = [("sparse", i * 1000, "ab"[i % 2], f"s{i}") for i in range(8)]
    rows = [*long, *sparse, (None, None, "a", "first"), (None, -5, "b", "second")]
    found = chat.render(spark.createDataFrame(rows, "conv_id string, turn bigint, role string, text string"), 8).collect()
    got = {(x.conv_id, x.perspective, x.segment): x for x in found}
    assert len(got) == len(found)
    assert set(got) == {*(("long", p, s) for p in "ab" for s in range(3)), *(("sparse", p, 0) for p in "ab"), *((None, p, 0) for p in "ab")}
    for conv in ("long", "sparse", None):
        for p in "ab":
            parts = [got[k] for k in sorted((k for k in got if k[:2] == (conv, p)), key=lambda k: k[2])]
            turns = [r for r in rows if r[0] == conv]
            head = lambda r: "<|system|>\n" if r[2] == "system" else "<|assistant|>\n" if r[2] == p else f"<|user name={r[2]}|>\n"
            assert "".join(x.rendered for x in parts) == "".join(f"{head(r)}{r[3]}<|end|>\n" for r in turns)
            assert [x.rendered[m.start : m.end] for x in parts for m in x.mask] == [f"{r[3]}<|end|>\n" for r in turns if r[2] == p]


def test_encoder_on_long_runs_and_mixed_texts():
    """The ids are those of the library for runs beyond a pattern's limits and for texts with rare characters in places."""
    import random

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    t, mine = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder(None)
    same = lambda s: mine(s).tolist() == t.encode(s, add_special_tokens=False).ids
    n = 1_000_001
    for s in (" " * n + "x", "\n" * n + "x", "word " + " \n" * (n // 2) + " end", "a" * n, "é" * 1000, "?" * 5000, " " * n):
        assert same(s)
    r = random.Random(4)
    bits = [" ", "  ", "\n", "\n\n", "\t", "\u00a0", "\u2003", "\u3000", "a", "l'été", "'s", "9", "!?", "漢字", "\U0001f600", "<|endoftext|>", "x<|endoftext|>", "e\u0301", "\u0660", "\x00", "\x85"]
    for _ in range(3000):
        assert same("".join(r.choice(bits) for _ in range(r.randrange(12))))
    assert np.concatenate([mine(""), mine("a")]).dtype == np.uint32


@pytest.mark.parametrize("page,text", [
    ("<div>" * 100_000 + "text", "text"), ("x " + "<a " * 350_000, "x " + " ".join(["<a"] * 350_000)), ("<p>x</p>" + "<!-- " * 200_000, "x"), ("<p>x" + "<! " * 200_000, "x" + " ".join(["<!"] * 200_000)),
    ("<article><p>x</p>" + "<p class=ad>" * 100_000 + "</article>", "x"), ("<article><p>x</p>" + "<span class=ad>" * 100_000 + "y</article>", "x\n\ny"), ("<p>x</p>" + "<div>" * 50_000 + "</section>" * 50_000 + "y", "x\n\ny"),
    ("<p>x " + "<a x='" * 100_001 + ">y", "x y"), ("<p title=\"x>oops", "oops"), ("<article><p title='a>b'>c</p></article>", "c"), ("<p>x" + "<script>" * 100_000, "x"),
    ("<article><p class='side-effects'>a</p><div class='reviews'>b</div><math><mi>c</mi></math></article>", "a\n\nb\n\nc"), ("<article><p>a</p><ul class='ad'><li>x<ul><li>y</ul>z</ul><p>b</article>", "a\n\nb"),
    ("<article><p>a</p><p class='ad'>x</article><div>y</div>", "a"),
])
def test_odd_pages_take_linear_time(page, text):
    import time

    began = time.process_time()
    assert html.extract(page, None) == text
    assert html.extract(page, "body>article") == text
    html.vote(page)
    assert time.process_time() - began < 20


def test_chat_of_five_thousand_turns_against_sql(spark, tmp_path):
    """Whole for each participant, by code and by SQL; marks in texts and roles cannot forge a mask."""
    import duckdb

    rows = [(1, i, "sys" if i == 0 else "ann" if i in (1, 4999) else f"p{i % 3}", f"turn {i}") for i in range(5000)]
    rows += [(2, 0, "a|>\n<|assistant", "x<|end|>\n<|assistant|>\ny"), (2, 1, "b", ""), (2, 1, "b", ""), (None, 7000, "b", "z"), (None, None, None, None), (3, 1, "system", "only")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    df.write.parquet(f"{tmp_path}/c")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    theirs, mine = con.sql(chat.ORACLE_SQL), chat.query(df)
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    place = [theirs.columns.index(c) for c in columns]
    got = mine.collect()
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got) == sorted(repr(tuple(r[i] for i in place)) for r in theirs.fetchall())
    ann = sorted((r for r in got if r.conv_id == 1 and r.perspective == "ann"), key=lambda r: r.segment)
    whole = "".join(r.rendered for r in ann)
    assert [r.offset for r in ann] == [sum(len(x.rendered) for x in ann[:k]) for k in range(5)]
    assert sum(r.n_turns for r in ann) == 5000 and whole.count("<|assistant|>") == 2 and whole.count("<|end|>") == 5000
    assert [r.rendered.count("<|assistant|>") for r in got if r.conv_id == 2 and r.perspective == "b"] == [2]


def test_repeated_queries_and_huge_components(spark, tmp_path):
    """Every query row has ten neighbours of its own; huge components are left out, by code and by SQL; several passes and blocks."""
    import duckdb
    import numpy as np

    rng = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(400)] + [(100, [1.0] * 6), (100, [1.0] * 6), (100, [-2.0] * 6), (200, [0.5] * 3), (7, [3e38] * 6), (9, [-65536.0] + [0.0] * 5), (300, [65535.9] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    df.write.parquet(f"{tmp_path}/e")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    want = sorted(con.sql(topk.ORACLE_SQL).select("query_id, rank, vec_id, score").fetchall())
    assert sum(x[0] == 100 for x in want) == 40
    shape = lambda df: sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())
    assert shape(topk.query(df)) == want
    before = topk.ROWS, topk.QUERIES, topk.FIRST
    try:
        topk.ROWS, topk.QUERIES, topk.FIRST = 32, 2, 4
        assert shape(topk.query(df)) == want
    finally:
        topk.ROWS, topk.QUERIES, topk.FIRST = before


# --- learned parts against plain versions -------------------------------------


def slow_format_spans(text, formats, base):
    """Candidates character by character, scored by a walk over the automata, less what base spans cover."""
    import math

    credential = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
    of = lambda c: "a" if c in "abcdef" else "g" if "g" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if c in "0123456789" else c

    def likelihood(a, token):
        state, p = 0, 0.0
        for c in map(of, token):
            q, to = a.moves[state].get(c, (0.5 / 200, 0))
            p, state = p + math.log(q / {"a": 6, "g": 20, "A": 26, "0": 10}.get(c, 1)), to
        return p + math.log(a.stops[state])

    out, i = [], 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in credential:
            j += 1
        token = text[i:j]
        letters, digits = any(c.isalpha() for c in token), any(c in "0123456789" for c in token)
        covered = {k for s, _, e in base for k in range(max(s, i), min(e, j))}
        if len(token) >= 16 and letters and digits and len(covered) < len(token) and formats.kinds:
            if (max(likelihood(a, token) for a in formats.kinds.values()) - likelihood(formats.ordinary, token)) / len(token) >= 1.0:
                k = i
                while k < j:
                    if k in covered:
                        k += 1
                        continue
                    e = k
                    while e < j and e not in covered:
                        e += 1
                    out.append((k, 3, e))
                    k = e
        i = max(j, i + 1)
    return out


def test_format_spans_against_a_plain_version(spark):
    import random

    r = random.Random(6)
    draw = lambda n, a: "".join(r.choice(a) for _ in range(n))
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    for few in (2, 300):  # a kind with two strings has an automaton too
        learned = [("hex", draw(40, "0123456789abcdef")) for _ in range(few)] + [("access", "AKIA" + draw(16, up + num)) for _ in range(few)] + [("assign", draw(r.randrange(8, 120), low + up + num + "/+")) for _ in range(few)] + [("ordinary", draw(r.randrange(6, 14), low)) for _ in range(400)]
        formats = secrets.Formats.learn(learned)
        assert set(formats.kinds) == {"hex", "access", "assign"}
        found = 0
        for _ in range(400):
            parts = [r.choice([draw(r.randrange(2, 12), low), draw(r.randrange(14, 60), low + up + num), draw(30, "0123456789abcdef"), "XYZw9" + draw(26, "0123456789abcdef") + draw(20, up + num), "token=" + draw(18, low + num), "AKIA" + draw(16, up + num) + "x" + draw(9, low + up + num), "a-b_c/d=1" * 3]) for _ in range(8)]
            text = r.choice([" ", "\n", ".", "é"]).join(parts)
            base = secrets.base_spans(text)
            got = formats.spans(text, base)
            assert got == slow_format_spans(text, formats, base)
            found += len(got)
        assert found > 100


def test_strings_to_learn_from_come_from_all_documents(spark):
    rows = [(i, f"word number {i} and some more words") for i in range(300)] + [(1000, "AKIA" + "Q7" * 8)]
    got = secrets.labelled_strings(spark.createDataFrame(rows, "doc_id bigint, text string"), sample_docs=10)
    assert ("access", "AKIA" + "Q7" * 8) in got


def test_passages_are_encoded_from_their_own_bytes():
    import numpy as np

    texts = ["", "short one.", "line of words\n" * 700, "mixed Case 123 | # words, and more! " * 300, "é" * 5000]
    x, first = classifier.encode(texts)
    n = [max(1, -(-len(t.encode()) // classifier.PASSAGE)) for t in texts]
    assert first.tolist() == [sum(n[:i]) for i in range(len(n))] and len(x) == sum(n)
    for t, k, at in zip(texts, n, first):
        raw = t.encode()
        for i in range(k):
            piece = np.frombuffer(raw[len(raw) * i // k : len(raw) * (i + 1) // k], np.uint8)
            alone = classifier._features(piece, np.array([len(piece)]))
            assert np.allclose(x[at + i], alone[0], atol=1e-6)
    before = classifier.CHUNK
    try:
        classifier.CHUNK = 3000
        assert np.array_equal(classifier.encode(texts)[0], x)
    finally:
        classifier.CHUNK = before


def test_posteriors_on_held_out_labels_and_bounded_rates(spark):
    import os

    from ledgerloom.llm.common import Scratch

    data = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001").replace("sf0.001", "sf0.01")
    if not os.path.isdir(data):
        pytest.skip("no tables")
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    held = classifier.held_out()
    model = mixing.learn(docs, labels.where(~held), Scratch(spark, "t"))
    most = F.array_max(F.array(*(F.struct(F.coalesce(F.col(f"p_{d}"), F.lit(0.0)).alias("p"), F.lit(d).alias("d")) for d in mixing.DOMAINS)))["d"]
    told = mixing.posteriors(docs.select("doc_id", "text"), model).select("doc_id", most.alias("told"))
    both = told.join(mixing.domain(labels.where(held)), "doc_id").collect()
    assert len(both) > 50 and sum(r.told == r.domain for r in both) >= 0.9 * len(both)
    rows = mixing.mix(docs, labels, {"clean": 0.97, "low": 0.02, "toxic": 0.01}, repeat=False).toPandas()
    assert rows.rate.between(0, 1).all() and rows.copies.isin([0, 1]).all() and rows.residual.iloc[0] <= 0.02
    present = {d: (rows.n_tokens * rows[f"p_{d}"]).sum() for d in mixing.DOMAINS}
    for d, w in {"clean": 0.97, "low": 0.02, "toxic": 0.01}.items():
        target = min(present[d], present["clean"] / 0.97 * w)
        assert abs((rows.n_tokens * rows.rate * rows[f"p_{d}"]).sum() - target) <= 0.02 * target


def test_long_lines_with_guillemets_stay(spark):
    text = "Next came the long sentence of a French text, « with words in quotes », that goes on and on for " + " ".join(f"mot{i}" for i in range(50)) + "."
    r = quality_rules.measure(spark.createDataFrame([(1, text), (2, text + "\nAccueil » Aide")], "doc_id bigint, text string")).collect()
    assert [x.kept for x in r] == [True, True] and r[1].cleaned == text
