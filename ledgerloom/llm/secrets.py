"""Secret scans by grammar inference.

Base patterns give spans of three kinds. Labelled credentials of these kinds
train one probabilistic automaton each: their prefix tree's states are merged
where the frequencies of what follows are statistically compatible (Hoeffding
bound), in breadth-first order. A fourth automaton is learned in the same way
from ordinary tokens. Every candidate token that no base span covers is scored
by its likelihood under each format against the ordinary automaton, and what
is likely enough becomes a further span.

Automata read character classes, not characters: credentials are random within
their format, so the format is the sequence of classes.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.shipping import ship

from .common import Scratch, sliced

# The base patterns, in the order of the kinds.
BASE = {
    "assign": re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
KINDS = (*BASE, "format")
LEAST = {"assign": 6, "access": 20, "hex": 24}
HEX = re.compile(r"[0-9a-f]{24,}")
#: Candidates: whole runs of credential characters, this long, with a letter and a digit; each one is scored.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
ORDINARY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{6,}(?![A-Za-z0-9+/_=-])")
#: Bounds of what is learned from: strings of a kind, and for ordinary tokens about so many documents, so many tokens of each.
SAMPLE_STRINGS, SAMPLE_DOCS, SAMPLE_TOKENS = 2_000, 20_000, 20
#: Confidence of the compatibility test, characters that decide, and log-odds per character that a secret needs.
ALPHA, DEPTH, LEAST_ODDS = 0.05, 64, 1.0

CLASS = {c: k for k, group in {"a": "abcdef", "g": "ghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0": "0123456789"}.items() for c in group}
#: Characters of each class: a class's probability is spread over them.
SIZE = {"a": 6, "g": 20, "A": 26, "0": 10}


def classes(token: str) -> str:
    """Letters a-f, other small letters, capitals and digits as a, g, A, 0; other characters as themselves."""
    return "".join(CLASS.get(c, c) for c in token)


class Automaton:
    """A probabilistic automaton: ``moves[state][symbol]`` is (probability, next), ``stops[state]`` a probability."""

    def __init__(self, moves: list[dict[str, tuple[float, int]]], stops: list[float]):
        self.moves, self.stops = moves, stops

    @classmethod
    def infer(cls, strings: Iterable[str], alpha: float = ALPHA, depth: int = DEPTH) -> Automaton:
        """Learn from ``strings`` of classes. Of longer ones the first ``depth`` characters count, and nothing is said about their end."""
        count, end = [0], [0]
        children: list[dict[str, int]] = [{}]
        for s in strings:
            at = 0
            count[0] += 1
            for c in s[:depth]:
                if c not in children[at]:
                    children[at][c] = len(count)
                    count.append(0)
                    end.append(0)
                    children.append({})
                at = children[at][c]
                count[at] += 1
            end[at] += len(s) <= depth
        bound = math.sqrt(0.5 * math.log(2 / alpha))

        def differ(x: int, n: int, y: int, m: int) -> bool:
            return n > 0 and m > 0 and abs(x / n - y / m) > bound * (n**-0.5 + m**-0.5)

        def compatible(a: int, b: int) -> bool:
            todo = [(a, b)]
            while todo:
                a, b = todo.pop()
                if count[b] == 0 or count[a] == 0:
                    continue
                if differ(end[a], count[a], end[b], count[b]):
                    return False
                for c in children[a].keys() | children[b].keys():
                    x, y = children[a].get(c), children[b].get(c)
                    if differ(passed[a].get(c, 0), count[a], passed[b].get(c, 0), count[b]):
                        return False
                    if x is not None and y is not None and x != y:
                        todo.append((x, y))
            return True

        passed = [{c: count[k] for c, k in kids.items()} for kids in children]

        def fold(a: int, b: int) -> None:
            """Add the tree below b to a."""
            todo = [(a, b)]
            while todo:
                a, b = todo.pop()
                count[a] += count[b]
                end[a] += end[b]
                for c, kid in children[b].items():
                    passed[a][c] = passed[a].get(c, 0) + passed[b][c]
                    if c in children[a]:
                        todo.append((children[a][c], kid))
                    else:
                        children[a][c] = kid
                children[b], passed[b], count[b], end[b] = {}, {}, 0, 0

        red = [0]
        while True:
            blue = [(r, c, k) for r in red for c, k in sorted(children[r].items()) if k not in red]
            if not blue:
                break
            parent, c, state = max(blue, key=lambda x: (count[x[2]], -x[2]))
            for r in red:
                if compatible(r, state):
                    children[parent][c] = r
                    fold(r, state)
                    break
            else:
                red.append(state)
        at = {r: i for i, r in enumerate(red)}
        moves, stops = [], []
        for r in red:
            total = count[r] + 0.5 * (len(children[r]) + 2)
            moves.append({c: ((passed[r].get(c, 0) + 0.5) / total, at[k]) for c, k in children[r].items()})
            stops.append((end[r] + 0.5) / total)
        return cls(moves, stops)

    def score(self, symbols: str) -> float:
        """Log-likelihood of a string of classes, as characters."""
        state, total = 0, 0.0
        for c in symbols:
            found = self.moves[state].get(c)
            p, to = found if found else (0.5 / 200, 0)
            total += math.log(p / SIZE.get(c, 1))
            state = to
        return total + math.log(self.stops[state])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the base spans, sorted."""
    found = [(m.start(), 0, m.end()) for m in BASE["assign"].finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in BASE["access"].finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]  # whole runs: the same as long matches of the base pattern
    return sorted(found)


class Formats:
    """The automata of the kinds and of ordinary tokens."""

    def __init__(self, kinds: dict[str, Automaton], ordinary: Automaton):
        self.kinds, self.ordinary = kinds, ordinary

    @classmethod
    def learn(cls, labelled: Iterable[tuple[str, str]], alpha: float = ALPHA) -> Formats:
        """From (kind, string) pairs; strings of kind "ordinary" are the others."""
        groups: dict[str, list[str]] = defaultdict(list)
        for kind, s in labelled:
            groups[kind].append(classes(s))
        ordinary = Automaton.infer(groups.pop("ordinary", []), alpha)
        return cls({k: Automaton.infer(v, alpha) for k, v in sorted(groups.items())}, ordinary)

    def odds(self, token: str) -> float:
        """The best format's log-likelihood over the ordinary one's, per character."""
        s = classes(token)
        if not self.kinds:
            return -math.inf
        return (max(a.score(s) for a in self.kinds.values()) - self.ordinary.score(s)) / len(s)

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Further spans: of each likely token what no base span covers. Tokens that are covered whole are not scored."""
        found, at, reach = [], 0, 0
        for m in CANDIDATE.finditer(text):
            free, begin = [], max(reach, m.start())
            while at < len(base) and base[at][0] < m.end():
                if base[at][0] > begin:
                    free.append((begin, 3, base[at][0]))
                reach, at = max(reach, base[at][2]), at + 1
                begin = max(begin, reach)
            if begin < m.end():
                free.append((begin, 3, m.end()))
            if free and self.odds(m[0]) >= LEAST_ODDS:
                found += free
        return found


def labelled_strings(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_strings: int = SAMPLE_STRINGS) -> list[tuple[str, str]]:
    """Credentials labelled by the base patterns in all documents, and ordinary tokens of some.

    At most ``sample_strings`` distinct strings of a kind, least hash first.
    Ordinary tokens come from about ``sample_docs`` documents by a hash of id
    and text, ``SAMPLE_TOKENS`` of each at even distances.
    """
    n = docs.count()
    usual = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-n // sample_docs)))) == 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, str], None] = {}
            for text, usual in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                text = text.as_py() or ""
                base = base_spans(text)
                for start, kind, end in base:
                    value = text[start:end] if kind else BASE["assign"].match(text, start)[2]
                    found["assign access hex".split()[kind], value[:256]] = None
                tokens = list(ORDINARY.finditer(text)) if usual else []
                for m in tokens[:: max(1, len(tokens) // SAMPLE_TOKENS)]:
                    if not any(s < m.end() and m.start() < e for s, _, e in base):
                        found["ordinary", m[0][:256]] = None
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], names=["kind", "value"])

    scratch = Scratch(docs.sparkSession, "secrets")
    found = scratch.keep(docs.select("text", usual.alias("usual")).mapInArrow(run, "kind string, value string").distinct())
    out: list[tuple[str, str]] = []
    for kind in (*BASE, "ordinary"):
        chosen = found.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(sample_strings)
        out += [(r.kind, r.value) for r in chosen.collect()]
    scratch.drop(found)
    return out


def scan(docs: DataFrame, formats: Formats | None = None, keep: tuple[str, ...] = ("doc_id", "text"), mark: str | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``spans`` array<struct<kind, start, end>>, for every row.

    Spans are in code points of ``text``, end exclusive, by start and then kind.
    With ``mark``, text is replaced by its redacted form and n_chars, if kept,
    follows. A null text stays and has no span; repeated rows and null ids stay;
    an empty table gives no rows; other columns are ignored. Without ``formats``
    these are learned from ``docs``; a kind of which there is no string has none.
    """
    ship(docs.sparkSession)
    if formats is None:
        formats = Formats.learn(labelled_strings(docs))
    docs = docs.select(*keep)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 256):
            texts, spans = batch.column("text").to_pylist(), []
            for i, text in enumerate(texts):
                base = base_spans(text or "")
                found = sorted(base + formats.spans(text or "", base))
                spans.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in found])
                if mark is not None:
                    texts[i] = redact(text, spans[-1], mark)
            columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"spans": pa.array(spans, kind)}
            if mark is not None:
                columns["text"] = pa.array(texts, pa.string())
                if "n_chars" in columns:
                    before = columns["n_chars"].to_pylist()
                    columns["n_chars"] = pa.array([len(t) if s else n for t, s, n in zip(texts, spans, before, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def redact(text: str | None, spans: list[dict], mark: str = "[{kind}]") -> str | None:
    """The text with each secret, overlapping ones joined, replaced by its kind."""
    if not text or not spans:
        return text
    out, at = [], 0
    merged: list[list] = []
    for s in spans:
        if merged and s["start"] < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s["end"])
        else:
            merged.append([s["start"], s["end"], s["kind"]])
    for start, end, kind in merged:
        out += [text[at:start], mark.format(kind=kind.upper())]
        at = end
    return "".join([*out, text[at:]])


def query(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in BASE),
        F.sha2(shown(F.filter("spans", lambda s: s["kind"] != "format")), 256).alias("base_sha256"),
        shown("spans").alias("spans"),
    )
