"""Personal data in texts: fixed patterns, and spans that weakly supervised labelers add.

Each kind (email, ip, card, phone) has a fixed base pattern, whose spans always stay. A
wider pattern of each kind gives candidates, among them numbers that the base pattern
loses because it ran into their neighbours. Five labelers vote on every candidate with
yes, no or abstain: a regex on its format, a gazetteer (top-level domains, issuers,
country codes, reserved addresses), a regex on its grouping, its neighbouring characters,
and cue words around it. Expectation-maximisation over the counts of vote patterns
estimates each labeler's reliability per kind without labels; its posteriors train a
logistic classifier by Newton steps, which decides about the candidates that meet no
base span of their kind.

DataFrame functions only. A text is read where it lies and nothing is shuffled by
document: a regex's matches and the pieces between them give positions by running sums
over lengths, so context is cut from pieces and a long text is read in linear time. What
is gathered over all documents are counts by kind and vote pattern, 972 rows at most,
and each step of the estimation collects sums of a fixed size.

Positions are code points, ends exclusive. Defined cases: a null text is empty; every
row has a row, repeated rows too; without candidates nothing is added; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Runs are possessive, and start where a run starts or the last match ended, so no text takes more than linear time or deep recursion; the matches are those of the plain patterns.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?+[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: What a candidate of each kind looks like.
WIDE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++|\x20?[\[(](?:at|@)[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?:dot|\.)[\])]\x20?)[A-Za-z0-9-]++)++|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++)",
    "ip": rf"(?<![0-9A-Fa-f:.])(?:{_OCTET}(?:\.{_OCTET}){{3}}|(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}})(?![0-9A-Fa-f:]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{16,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9])",
    "phone": r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])|(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: What a text with a match of either pattern must hold, digits grouped in any way; cheaper than the patterns.
NEEDED = {"email": "@|[Aa][Tt]", "ip": "[0-9A-Fa-f][.:]", "card": r"[0-9](?:[\x20-]?[0-9]){3}", "phone": r"\+[0-9]|[0-9]{3}"}

#: Gazetteers and cue words.
DOMAINS = "com org net edu gov mil int info biz io dev app me eu de fr es it uk ie nl be at ch pl pt se no dk fi cz gr ru ua tr in cn jp kr au nz ca us mx br ar cl co za"
COUNTRY_CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[12368]|35[0-9]|37[0-9]|38[0-9]|42[013]|85[2356]|88[06]|97[1-7])"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[4-7]|6[0245])"
RESERVED = r"^(?:0|10|127|169\.254|192\.168|2[2-5][0-9])\."
YES = {
    "email": r"e-?mail|contact|write|reply|courriel|correo|kontakt|escrib|schreib|\bto:|\bfrom:",
    "ip": r"\bip\b|address|host|server|client|login|adresse|direcci[oó]n|serveur|servidor",
    "card": r"card|visa|credit|debit|payment|carte|tarjeta|karte|kredit",
    "phone": r"phone|\btel\b|t[eé]l|call|mobile|fax|appel|llam|anruf|handy|whatsapp",
}
NO = r"version|release|isbn|order (?:no|number)|invoice|serial|token|hash|checksum|uuid|section|chapter|doi|build"

LABELERS = ("format", "gazetteer", "grouping", "neighbours", "cues")
ROUNDS, STEPS, THRESHOLD = 25, 12, 0.5
#: How often each labeler's votes are taken to be right at first; so many votes of that kind are added to the counted ones. A format has a check sum or ranges, so it starts as the surest.
RELIABILITY, PRIOR_VOTES = (0.97, 0.65, 0.65, 0.8, 0.8), 20.0
BEFORE, AFTER = 40, 20
_CHUNK = 256


def _once(value, use):
    """``use(value)`` with the value computed once, however often a lambda inside asks for it."""
    return F.transform(F.array(value), use)[0]


def running(values):
    """The running sums of an array of whole numbers, in chunks, so that long arrays are not copied for each entry."""
    scan = lambda part, start: F.aggregate(part, F.array(start), lambda done, v: F.concat(done, F.array(F.element_at(done, -1) + v)))
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, v: a + v)

    def chunked(all_values):
        parts = F.transform(F.sequence(F.lit(1), F.size(all_values), F.lit(_CHUNK)), lambda i: F.slice(all_values, i, _CHUNK))
        return _once(parts, lambda p: F.flatten(F.zip_with(p, F.slice(scan(F.transform(p, total), F.lit(0)), 1, F.size(p)), lambda part, start: F.slice(scan(part, start), 2, _CHUNK))))

    return _once(values, chunked)


def matches(text, pattern: str, needed: str):
    """Array of (start, end, match, before, after) of a pattern's leftmost matches; the contexts are the pieces
    between matches, cut to ``BEFORE`` and ``AFTER`` code points."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(both):
        m, p = both["m"], both["p"]
        steps = F.zip_with(p, F.concat(F.array(F.lit(0)), F.transform(m, lambda x: F.length(x))), lambda piece, size: F.length(piece) + size)
        ends = F.slice(p, F.lit(2), F.size(m))
        rows = F.arrays_zip(m, F.slice(running(steps), F.lit(1), F.size(m)), F.slice(p, F.lit(1), F.size(m)), ends)
        return F.transform(rows, lambda r: F.struct(r["1"].alias("start"), (r["1"] + F.length(r["m"])).alias("end"), r["m"].alias("match"), F.right(r["2"], F.lit(BEFORE)).alias("before"), F.left(r["3"], F.lit(AFTER)).alias("after")))

    kind = "array<struct<start:int,end:int,match:string,before:string,after:string>>"
    return F.when(text.rlike(needed) & text.rlike(pattern), _once(F.struct(found.alias("m"), pieces.alias("p")), placed).cast(kind)).otherwise(F.array().cast(kind))


def digits(match):
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number):
    """Whether the Luhn sum of a short string of digits is a multiple of ten."""

    def checked(d):
        value = lambda i: F.substr(d, i, F.lit(1)).cast("int") * F.when((F.length(d) - i) % 2 == 1, 2).otherwise(1)
        total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(d)), value), F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0))
        return total % 10 == 0

    return _once(number, checked)


def valid(kind: str, match):
    """The base rule of a kind beyond its pattern."""
    if kind == "ip":
        return match.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind == "card":
        return _once(digits(match), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits(match)).between(8, 15)
    return F.lit(True)


def votes(kind: str, c) -> list:
    """The labelers' votes on a candidate: 1, -1, or 0 where they abstain."""
    match, before, after = c["match"], c["before"], c["after"]
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    if kind == "email":
        plain = F.contains(match, F.lit("@"))
        listed = F.lower(F.regexp_extract(match, r"([A-Za-z]+)$", 1)).isin(*DOMAINS.split())
        form = vote(plain & match.rlike(r"^[A-Za-z0-9].*\.[A-Za-z]{2,}$"), ~match.rlike(r"[A-Za-z]{2,}$"))
        own = [form, vote(listed, ~listed), vote(match.rlike(r"@|[\[(]"), F.lit(False))]
    elif kind == "ip":
        own = [vote(valid("ip", match) | F.contains(match, F.lit(":")), F.lit(True)), vote(F.lit(False), match.rlike(RESERVED)), vote(match.rlike(r"[0-9]{2,}\.|:"), F.lit(False))]
    elif kind == "card":
        own = [vote(valid("card", match), F.lit(True)), vote(digits(match).rlike(ISSUERS), F.lit(False)), vote(match.rlike(r"^(?:[0-9]{16}|[0-9]{4}(?:[\x20-][0-9]{4}){3})$"), F.lit(False))]
    else:
        abroad = match.startswith("+")
        own = [vote(abroad & valid("phone", match), ~valid("phone", match)), vote(match.rlike(COUNTRY_CODES), abroad), vote(match.rlike(r"\(|[0-9][\x20.-][0-9]+[\x20.-][0-9]"), F.lit(False))]
    glued = before.rlike(r"[A-Za-z0-9_@#=/]$") | after.rlike(r"^[A-Za-z0-9_@/]")
    near = F.lower(F.concat_ws(" ", before, after))
    return [*own, vote(~glued, glued), vote(near.rlike(YES[kind]), near.rlike(NO))]


def code(votes: list):
    """Votes as one number, three values a labeler."""
    return sum(((v + 1) * 3**i for i, v in enumerate(votes)), F.lit(0))


def vote_of(code, labeler: int):
    return F.floor(code / 3**labeler).cast("int") % 3 - 1


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id, the base spans (kind: array of start and end), and per kind the candidates with the code of their votes."""
    text = F.coalesce("text", F.lit(""))
    base = lambda k: F.transform(F.filter(matches(text, BASE[k], NEEDED[k]), lambda m: valid(k, m["match"])), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
    wide = lambda k: F.transform(matches(text, WIDE[k], NEEDED[k]), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), code(votes(k, m)).alias("votes")))
    return documents.select("doc_id", *[base(k).alias(f"base_{k}") for k in KINDS], *[wide(k).alias(f"wide_{k}") for k in KINDS])


@dataclass(frozen=True)
class Reliability:
    """Per kind the share of real spans, and per kind, labeler and vote the log ratio of its rates among real and other spans."""

    share: tuple[float, ...]
    ratios: tuple[float, ...]

    def posterior(self, kind, code):
        at = lambda i: F.element_at(F.lit(list(self.ratios)), kind * len(LABELERS) * 3 + i * 3 + vote_of(code, i) + 2)
        start = F.element_at(F.lit([math.log(s / (1 - s)) for s in self.share]), kind + 1)
        return 1 / (1 + F.exp(-sum(map(at, range(len(LABELERS))), start)))


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> Reliability:
    """The labelers' reliabilities by expectation-maximisation over (kind, votes, n): each round weighs the patterns
    by the last round's model and collects the sums by kind, labeler and vote."""
    rates = np.empty((len(KINDS), len(LABELERS), 3, 2))
    first = np.array([[[(1 - r) * 0.7, r * 0.7], [0.3, 0.3], [r * 0.7, (1 - r) * 0.7]] for r in RELIABILITY])
    rates[:] = first
    share = np.full(len(KINDS), 0.5)
    model = Reliability(tuple(share), tuple(np.log(rates[..., 0] / rates[..., 1]).ravel()))
    for _ in range(rounds):
        weighed = patterns.withColumn("p", model.posterior(F.col("kind"), F.col("votes")))
        each = weighed.select("kind", "n", "p", F.posexplode(F.array(*[vote_of(F.col("votes"), i) for i in range(len(LABELERS))])).alias("labeler", "vote"))
        sums = np.zeros((len(KINDS), len(LABELERS), 3, 2))
        for r in each.groupBy("kind", "labeler", "vote").agg(F.sum(F.col("n") * F.col("p")).alias("real"), F.sum(F.col("n") * (1 - F.col("p"))).alias("other")).collect():
            sums[r["kind"], r["labeler"], r["vote"] + 1] = r["real"], r["other"]
        total = sums[:, 0].sum(axis=1)
        share = (total[:, 0] + PRIOR_VOTES / 2) / (total.sum(axis=1) + PRIOR_VOTES)
        counted = sums + PRIOR_VOTES * first
        rates = counted / counted.sum(axis=2, keepdims=True)
        before, model = model, Reliability(tuple(map(float, share)), tuple(map(float, np.log(rates[..., 0] / rates[..., 1]).ravel())))
        if max(abs(a - b) for a, b in zip(before.ratios + before.share, model.ratios + model.share, strict=True)) < 1e-4:
            break
    return model


def _features(kind, code) -> list:
    one = lambda yes: F.when(yes, 1.0).otherwise(0.0)
    return [F.lit(1.0), *[one(kind == k) for k in range(1, len(KINDS))], *[vote_of(code, i).cast("double") for i in range(len(LABELERS))]]


def score(weights: list[float], kind, code):
    """The classifier's probability that a candidate is real."""
    return 1 / (1 + F.exp(-sum((w * x for w, x in zip(weights, _features(kind, code), strict=True)), F.lit(0.0))))


def train(patterns: DataFrame, model: Reliability, steps: int = STEPS, ridge: float = 1.0) -> list[float]:
    """Weights of a logistic classifier of the votes, fitted to the posteriors by Newton steps."""
    rows = patterns.withColumn("p", model.posterior(F.col("kind"), F.col("votes")))
    d = 1 + len(KINDS) - 1 + len(LABELERS)
    weights = np.zeros(d)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = _features(F.col("kind"), F.col("votes"))
    for _ in range(steps):
        made = rows.withColumn("s", score(weights.tolist(), F.col("kind"), F.col("votes")))
        slope = [F.sum(F.col("n") * (F.col("p") - F.col("s")) * x[i]) for i in range(d)]
        bend = [F.sum(F.col("n") * F.col("s") * (1 - F.col("s")) * x[i] * x[j]) for i, j in pairs]
        sums = list(made.agg(*[c.alias(f"c{i}") for i, c in enumerate(slope + bend)]).first())
        hessian = np.zeros((d, d))
        for (i, j), v in zip(pairs, sums[d:], strict=True):
            hessian[i, j] = hessian[j, i] = v
        change = np.linalg.solve(hessian + ridge * np.eye(d), np.array(sums[:d]) - ridge * weights)
        weights += change / max(1.0, float(np.abs(change).max()) / 4)
        if np.abs(change).max() < 1e-6:
            break
    return weights.tolist()


def _apart(spans, base):
    """Those of ``spans`` that meet none of the sorted, disjoint spans ``base``, by bisection."""

    def meets(c, b):
        state = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
        middle = lambda s: F.floor((s["low"] + s["high"]) / 2).cast("int")
        smaller = lambda s: F.get(b, middle(s))["start"] < c["end"]
        step = lambda s, _: F.when(s["low"] >= s["high"], s).when(smaller(s), state(middle(s) + 1, s["high"] + 0)).otherwise(state(s["low"] + 0, middle(s)))
        last = F.aggregate(F.sequence(F.lit(1), F.length(F.bin(F.size(b)))), state(F.lit(0), F.size(b)), step, lambda s: s["low"])
        return F.coalesce(F.get(b, last - 1)["end"] > c["start"], F.lit(False))

    return _once(base, lambda b: F.filter(spans, lambda c: ~meets(c, b)))


def find(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and ``spans``, an array of (kind, start, end, is_base, score) of every row of ``documents`` (doc_id,
    text), by kind as listed, then by start; base spans have score 1."""
    rows = durable(candidates(documents))
    cast = lambda i, k: F.transform(f"wide_{k}", lambda c: F.struct(F.lit(i).alias("kind"), (c["votes"] + 0).alias("votes")))
    each = rows.select(F.explode(F.concat(*[cast(i, k) for i, k in enumerate(KINDS)])).alias("c")).select("c.*")
    patterns = durable(each.groupBy("kind", "votes").agg(F.count("*").alias("n"))).coalesce(1)
    weights = None if patterns.isEmpty() else train(patterns, estimate(patterns))
    kind = "array<struct<kind:string,start:int,end:int,is_base:boolean,score:double>>"

    def of(i, k):
        made = lambda c, sure, s: F.struct(F.lit(k).alias("kind"), (c["start"] + 0).alias("start"), (c["end"] + 0).alias("end"), F.lit(sure).alias("is_base"), s.alias("score"))
        own = F.transform(f"base_{k}", lambda c: made(c, True, F.lit(1.0))).cast(kind)
        if weights is None:
            return own
        taken = F.filter(f"wide_{k}", lambda c: score(weights, F.lit(i), c["votes"]) >= threshold)
        added = F.transform(_apart(taken, F.col(f"base_{k}")), lambda c: made(c, False, score(weights, F.lit(i), c["votes"]))).cast(kind)
        return F.array_sort(F.concat(own, added))

    return rows.select("doc_id", F.concat(*[of(i, k) for i, k in enumerate(KINDS)]).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, the digest of the base spans and all spans as text."""
    base = F.filter("spans", lambda s: s["is_base"])
    shown = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    of = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
