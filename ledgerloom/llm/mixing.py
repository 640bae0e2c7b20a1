"""Mixing to target weights with soft domain membership, with built-in functions only.

A classifier learned from the labels table gives every document a posterior
over domains. Rates r >= 0 for all documents are then fitted so that the
expected tokens of each domain, sum of r * tokens * posterior, match their
targets: projected gradient descent on the least squares
``sum over domains of (expected - target)^2 / present``. In this scaling the
largest curvature is 1, so steps of length 1 descend. One step needs a few
sums over the table of tokens and posteriors; a document's rate is a function
of its posterior and the steps' residuals and is never shuffled.

The classifier is naive Bayes over text statistics and counts of telling
words, fitted by SQL aggregates on a bounded sample of labels
(``SAMPLE_DOCS``); it scores all documents whole.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

DOMAINS = ("clean", "low", "toxic")
WEIGHTS = {"clean": 0.90, "low": 0.08, "toxic": 0.02}
SAMPLE_DOCS, WORDS, LEAST_WEIGHT = 6000, 48, 20
STEPS, TOLERANCE, STILL = 48, 1e-3, 1e-4
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
MARKS = ".,;:!?\"'()[]{}#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STATISTICS = ("f_length", "f_marks", "f_capitals", "f_distinct", *(f"f_{d}" for d in DOMAINS))


@dataclass
class Model:
    """Telling words of each domain, priors, and (mean, variance) of each statistic in each domain."""

    words: dict[str, list[str]]
    priors: dict[str, float]
    moments: dict[str, dict[str, tuple[float, float]]]


def domain(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from ``labels(doc_id, quality, toxic)``; rows with a null are left out."""
    named = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")
    return labels.select("doc_id", named.alias("domain")).where("doc_id IS NOT NULL AND domain IS NOT NULL")


def _words() -> Column:
    plain = F.lower(F.translate(F.coalesce("text", F.lit("")), MARKS, ""))
    return F.filter(F.split(plain, SPACE), lambda w: w != "")


def statistics(docs: DataFrame, words: dict[str, list[str]]) -> DataFrame:
    """``docs`` with n_tokens (its words) and the statistics that the classifier reads."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.withColumn("_words", _words())
    docs = docs.withColumn("_distinct", F.array_distinct("_words"))
    chars = F.greatest(F.length(text), F.lit(1))
    share = lambda group: (F.length(text) - F.length(F.translate(text, group, ""))) / chars
    docs = docs.withColumns({
        "n_tokens": F.size("_words").cast("long"),
        "f_length": F.log1p(F.size("_words")),
        "f_marks": share(MARKS + "-_/"),
        "f_capitals": share(CAPITALS),
        "f_distinct": F.size("_distinct") / F.greatest(F.size("_words"), F.lit(1)),
    } | {f"f_{d}": F.log1p(F.size(F.array_intersect("_distinct", F.array(*map(F.lit, words.get(d) or [""]))))) for d in DOMAINS})
    return docs.drop("_words", "_distinct")


def learn(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> Model:
    """Fit on at most ``SAMPLE_DOCS`` labelled documents, least hash of the id first."""
    chosen = domain(labels).orderBy(F.xxhash64("doc_id"), "domain").limit(SAMPLE_DOCS)
    # the sample's bound makes this side small
    sample = scratch.keep(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    sizes = {r.domain: r.n for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    counted = sample.select("domain", F.explode(F.array_distinct(_words())).alias("word")).groupBy("word").pivot("domain", list(DOMAINS)).count().na.fill(0)
    telling = {}
    for d in DOMAINS:
        rest = sum((F.col(o) for o in DOMAINS if o != d), F.lit(0))
        odds = F.log((F.col(d) + 0.5) / (sizes.get(d, 0) + 1)) - F.log((rest + 0.5) / (total - sizes.get(d, 0) + 1))
        weight = F.col(d) * odds  # documents times odds: what a word tells beyond chance
        found = counted.where((odds > 1) & (weight >= LEAST_WEIGHT)).select("word", weight.alias("weight")).orderBy(F.desc("weight"), "word").limit(WORDS)
        telling[d] = [r.word for r in found.collect()]
    described = statistics(sample, telling)
    parts = [x for s in STATISTICS for x in (F.avg(s).alias(f"m_{s}"), F.var_pop(s).alias(f"v_{s}"))]
    rows = {r.domain: r for r in described.groupBy("domain").agg(*parts).collect()}
    moments = {d: {s: (r[f"m_{s}"], r[f"v_{s}"] + 1e-3) for s in STATISTICS} for d, r in rows.items()}
    return Model(telling, {d: sizes[d] / total for d in moments}, moments)


def posteriors(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with n_tokens and a posterior ``p_<domain>`` for each domain. Without a label, all count for the first."""
    if not model.priors:
        docs = docs.withColumn("n_tokens", F.size(_words()).cast("long"))
        return docs.withColumns({f"p_{d}": F.lit(float(d == DOMAINS[0])) for d in DOMAINS})
    docs = statistics(docs, model.words)
    logs = {}
    for d, prior in model.priors.items():
        total = F.lit(math.log(prior))
        for s, (mean, var) in model.moments[d].items():
            total = total - (F.col(s) - mean) * (F.col(s) - mean) / (2 * var) - 0.5 * math.log(var)
        logs[f"_l_{d}"] = total
    docs = docs.withColumns(logs).drop(*STATISTICS)
    top = F.greatest(*logs, F.lit(-1e300))
    docs = docs.withColumns({f"_e_{d}": F.exp(F.col(f"_l_{d}") - top) for d in model.priors})
    whole = sum((F.col(f"_e_{d}") for d in model.priors), F.lit(0.0))
    docs = docs.withColumns({f"p_{d}": F.col(f"_e_{d}") / whole if d in model.priors else F.lit(0.0) for d in DOMAINS})
    return docs.drop(*logs, *(f"_e_{d}" for d in model.priors))


def rate(steps: list[list[float]], repeat: bool = True) -> Column:
    """A document's rate after the steps: each takes off the residuals its posterior meets, down to zero at most, and with ``repeat`` false up to one."""
    r = F.lit(1.0)
    for step in steps:
        r = F.greatest(F.lit(0.0), r - sum((F.col(f"p_{d}") * F.lit(x) for d, x in zip(DOMAINS, step, strict=True)), F.lit(0.0)))
        r = r if repeat else F.least(F.lit(1.0), r)
    return r


@dataclass
class Fit:
    """Steps of the descent, the tokens wanted of each domain, and those that the fitted rates give."""

    steps: list[list[float]]
    target: dict[str, float]
    reached: dict[str, float]

    @property
    def residual(self) -> float:
        """The largest miss of a domain as a share of its target."""
        return max((abs(self.reached[d] - t) / t for d, t in self.target.items() if t > 0), default=0.0)


def fit_rates(members: DataFrame, weights: dict[str, float], repeat: bool = True) -> Fit:
    """Projected gradient descent for ``members(n_tokens, p_*)``, until targets are met or steps move nothing; warns of a target missed by 1 %.

    Targets have the proportions of ``weights`` and keep the first domain's
    present tokens. Domains without tokens are left out. With ``repeat`` false
    no target exceeds what is present.
    """
    sums = lambda r: [F.sum(r * F.col("n_tokens") * F.col(f"p_{d}")).alias(d) for d in DOMAINS]
    present = members.agg(*sums(F.lit(1.0))).first()
    present = {d: present[d] or 0.0 for d in DOMAINS}
    scale = present[DOMAINS[0]] / weights[DOMAINS[0]] if present[DOMAINS[0]] else sum(present.values())
    target = {d: scale * weights[d] if present[d] > 0 else 0.0 for d in DOMAINS}
    if not repeat:
        target = {d: min(target[d], present[d]) for d in DOMAINS}
    steps: list[list[float]] = []
    now = present
    for _ in range(STEPS):
        off = {d: (now[d] - target[d]) / present[d] if present[d] > 0 else 0.0 for d in DOMAINS}
        if max(abs(now[d] - target[d]) for d in DOMAINS) <= TOLERANCE * max(1.0, min((t for t in target.values() if t > 0), default=1.0)):
            break
        steps.append([off[d] for d in DOMAINS])
        found = members.agg(*sums(rate(steps, repeat))).first()
        before, now = now, {d: found[d] or 0.0 for d in DOMAINS}
        if all(abs(now[d] - before[d]) <= STILL * target[d] for d in DOMAINS):  # no nearer by descent: the targets exclude each other
            break
    if steps and (miss := Fit(steps, target, now).residual) > 10 * TOLERANCE:
        warnings.warn(f"the mix misses a domain by {miss:.1%}: reached {now}, wanted {target}", stacklevel=2)
    return Fit(steps, target, now)


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, repeat: bool = True) -> DataFrame:
    """``docs(doc_id, text, ...)`` with n_tokens, p_<domain>, rate, copies and residual.

    residual is the same in all rows: the largest miss of a domain's expected
    tokens as a share of its target. Tokens are words, which built-in functions
    can count; ids of a tokenizer would need Python.

    copies rounds the rate up or down by a hash of the id and the text, so that
    its expectation is the rate; with ``repeat`` false it is 1 at most. Null and
    empty texts have no token and still get a posterior and a rate. Repeated
    rows count each; null ids stay; columns of these names are replaced; an
    empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    model = learn(docs, labels, scratch)
    made = ["n_tokens", "rate", "copies", "residual", *(f"p_{d}" for d in DOMAINS), *STATISTICS]
    members = scratch.keep(posteriors(docs.drop(*made), model))
    fit = fit_rates(members, weights or WEIGHTS, repeat)
    even = F.pmod(F.xxhash64(F.lit(9), "doc_id", F.coalesce("text", F.lit(""))), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor(F.col("rate") + even).cast("long")
    return members.withColumns({"rate": rate(fit.steps, repeat), "residual": F.lit(fit.residual)}).withColumn("copies", copies if repeat else F.least(copies, F.lit(1).cast("long")))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "text"), labels).select("doc_id", "n_tokens", *(f"p_{d}" for d in DOMAINS), "rate", "copies", "residual")
