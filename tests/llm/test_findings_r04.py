"""What the findings of the fourth round were about."""

import random

from pyspark.sql import functions as F

from ledgerloom.llm import suffix


def test_suffix_rows_are_not_a_pair_of_chunk_and_part_each(spark, monkeypatch):
    """rows of segments grew with the square of the input, chunks times parts."""
    monkeypatch.setattr(suffix, "CHUNK", 2_000)
    monkeypatch.setattr(suffix, "PART", 400)
    monkeypatch.setattr(suffix, "DEALT", 3_000)
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    shared = [word(r.randrange(60, 200)) for _ in range(30)]
    rows = [(k, word(40) + r.choice(shared) + word(30) + r.choice(shared) + r.choice(shared)) for k in range(150)] + [(900, shared[0]), (901, shared[0] + "é" * 60), (902, None)]
    kept, keep = {}, suffix.Scratch.keep

    def spy(self, df):
        out = keep(self, df)
        if "windows" in out.columns:
            dealt = out.where("part >= 0").withColumn("task", F.input_file_name())
            kept["rows"], kept["cells"] = dealt.count(), dealt.select("task", "part").distinct().count()
        elif "shas" in out.columns:
            kept["chunks"] = out.count()
        return out

    monkeypatch.setattr(suffix.Scratch, "keep", spy)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in suffix.remove_repeats(docs).collect()}
    assert kept["chunks"] > 20 and kept["rows"] == kept["cells"]  # before: a row for each pair
    first: dict[bytes, int] = {}
    raw = {k: (t or "").encode() for k, t in rows}
    for k in sorted(raw):
        for i in range(len(raw[k]) - 49):
            first.setdefault(raw[k][i : i + 50], k)
    for k, text in raw.items():
        gone = {j for i in range(len(text) - 49) if first[text[i : i + 50]] < k for j in range(i, i + 50)}
        assert (got[k].n_removed, bytes(got[k].kept)) == (len(gone), bytes(b for j, b in enumerate(text) if j not in gone))
        assert got[k].n_spans == sum(j - 1 not in gone for j in gone)
