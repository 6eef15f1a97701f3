"""Personal data by weak supervision.

Every candidate span (a regular expression's match, or a looser form of one) is voted on by
labelers of three sorts: patterns (the base rule of a kind), gazetteers (mail providers,
top-level domains, networks, card issuers' prefixes and lengths, calling codes) and context (words before the span, neighbours).
Expectation-maximisation over the vote patterns' counts estimates each labeler's reliability and
each kind's prior, without labels.  The posteriors then train a span classifier, a logistic model of the
votes (but the base rule's) and of the span's form, that decides about spans outside the base.  Base spans always stay.

What is gathered is one count a (kind, pattern of votes and form), of which there are at most 512 a
kind, so it doesn't grow with the corpus.

Cases: null counts as the empty text, which has no spans; whole texts of any length are searched in linear time;
an empty table gives no rows; repeated rows count each and get equal spans; of loose spans that overlap the first, then the longest, then
the kind listed first is a candidate; of the table only the named columns are read, so columns of the names used here don't matter.
"""

from __future__ import annotations

import bisect
import itertools
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone")
#: Probability from which the classifier adds a span.
ADD = 0.9

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]")

# looser forms, from which the classifier may add spans
_LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[(\[]at[)\]]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\x20?[(\[]dot[)\]]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]++)+", re.I | re.A),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9.])[0-9]{4}([\x20./-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9.])"),
    "phone": re.compile(r"(?<![0-9.+-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])"),
}
_CUES = {
    "email": re.compile(r"(?:e-?mail|mail|contact|write|address)\W*$", re.I | re.A),
    "ip": re.compile(r"(?:\bip|host|server|address|from|login)\W*$", re.I | re.A),
    "card": re.compile(r"(?:card|visa|master|amex|credit|payment)\W*(?:(?:no|number)\W*)?$", re.I | re.A),
    "phone": re.compile(r"(?:phone|tel|call|mobile|cell|fax)\W*$", re.I | re.A),
}
# Well-known generic top-level domains (those of countries have two letters) and mail providers.
_TLDS = frozenset("com org net edu gov mil int info biz name pro io co ai app dev me tv cloud online site store tech xyz".split())
_PROVIDERS = frozenset("gmail googlemail outlook hotmail live msn yahoo ymail icloud aol gmx web mail proton protonmail zoho fastmail yandex qq 163 example".split())
# issuers' prefixes of card numbers, as (first, last, lengths).
_CARDS = (
    ("300", "305", {14}), ("34", "34", {15}), ("3528", "3589", {16, 17, 18, 19}), ("36", "36", {14}), ("37", "37", {15}), ("38", "39", {14}),
    ("4", "4", {13, 16, 19}), ("50", "50", {*range(13, 20)}), ("51", "55", {16}), ("56", "58", {*range(13, 20)}), ("2221", "2720", {16}),
    ("6011", "6011", {16, 17, 18, 19}), ("62", "62", {16, 17, 18, 19}), ("644", "649", {16, 17, 18, 19}), ("65", "65", {16, 17, 18, 19}),
)
# Calling codes of one and two digits; three digits by their zones.
_CALLING = re.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|(?:2[1-69]|3[578]|42|5[09]|6[789]|8[0578]|9[679])[0-9]")
LABELERS = ("pattern", "gazetteer", "cue", "apart", "company")
#: What the classifier sees of a span's form: of usual length, more than half digits, one sort of separator at most, an end of words behind it.
FORMS = ("usual", "digits", "even", "closed")
_USUAL = {"email": (8, 40), "ip": (7, 39), "card": (15, 19), "phone": (10, 18)}


def _known(kind: int, span: str, digits: str) -> bool:
    """Whether a gazetteer has a span: top-level domain or provider, network, card issuer, calling code."""
    if kind == 0:
        labels = re.split(r"\W+", span.lower())
        return labels[-1] in _TLDS or len(labels[-1]) == 2 and labels[-1].isalpha() or not _PROVIDERS.isdisjoint(labels)
    if kind == 1:
        return span.lower().startswith(("2", "3", "fe8", "fe9", "fea", "feb", "fc", "fd")) if ":" in span else 1 <= int(span.split(".")[0]) <= 223
    if kind == 2:
        return luhn(digits) and any(low <= digits[: len(low)] <= high and len(digits) in sizes for low, high, sizes in _CARDS)
    return bool(_CALLING.match(digits)) if span[0] == "+" else len(digits) == 10 and digits[0] not in "01" and digits[3] not in "01"


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base rules, by kind, then start."""
    out = []
    at, low = text.find("@"), 0
    while at >= 0:
        # only the run of local characters before an @ can start a match there
        start = low + len(text[low:at].rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((0, start, found.end()))
        low = found.end() if found else at + 1
        at = text.find("@", low)
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _DIGITS.sub("", m.group())) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m.group())) <= 15]
    return out


def _votes(text: str, kind: int, start: int, end: int, base: bool, others: bool) -> int:
    """The labelers' votes on a span as bits, then those of its form."""
    span = text[start:end]
    digits = _DIGITS.sub("", span)
    cue = bool(_CUES[KINDS[kind]].search(text[max(0, start - 24) : start]))
    before, behind = text[start - 1 : start] if start else "", text[end : end + 1]
    apart = not (before.isalnum() or behind.isalnum())
    low, high = _USUAL[KINDS[kind]]
    separators = set(span) - set("0123456789") if kind > 1 else set(span) & set(" ([.:")
    form = (low <= len(span) <= high) | (2 * len(digits) > len(span)) << 1 | (len(separators - {"+", "(", ")"}) <= 1) << 2 | (not behind or behind in " \n\t.,;:!?)'\"") << 3
    return base | _known(kind, span, digits) << 1 | cue << 2 | apart << 3 | others << 4 | form << len(LABELERS)


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, votes) of all candidates, base spans first in order; of loose ones that overlap the first and longest."""
    base = base_spans(text)
    spans = [(k, a, b, True) for k, a, b in base]
    loose = []
    spelt = _SPELT.search(text)
    for k, name in enumerate(KINDS):
        if k == 0 and not spelt or k == 1 and text.count(":") < 7 or k > 1 and not _SOME.search(text):
            continue
        loose += [(k, m.start(), m.end()) for m in _LOOSE[name].finditer(text)]
    if loose:
        taken = sorted((a, b) for _, a, b in base)
        starts = [a for a, _ in taken]
        # the furthest end of all base spans up to each
        ends = list(itertools.accumulate((b for _, b in taken), max))
        far = 0
        for k, a, b in sorted(loose, key=lambda x: (x[1], -x[2])):
            i = bisect.bisect_left(starts, b)
            if a >= far and (not i or ends[i - 1] <= a):
                spans.append((k, a, b, False))
                far = b
    near = sorted(a for _, a, _, _ in spans)
    out = []
    for k, a, b, is_base in spans:
        i = bisect.bisect_left(near, a - 200)
        others = bisect.bisect_right(near, b + 200) - i > 1
        out.append((k, a, b, _votes(text, k, a, b, is_base, others)))
    return out


# what every match of the loose email, and of the loose card or phone, holds
_SPELT = re.compile(r"\x20at\x20|[(\[]at[)\]]", re.I | re.A)
_SOME = re.compile(r"[0-9]{3}[\x20./)-]")


def em(counts: np.ndarray, rounds: int = 50) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Prior, hit and false alarm rates of the labelers and the posterior of each vote pattern, from the patterns' counts.

    The pattern and gazetteer labelers start as more often right than not, which fixes the sides.
    """
    n = len(LABELERS)
    bits = (np.arange(2**n)[:, None] >> np.arange(n)) & 1
    prior, hit, false = 0.7, np.array([0.9, 0.8, 0.4, 0.8, 0.4]), np.array([0.2, 0.3, 0.1, 0.5, 0.2])
    post = np.full(2**n, prior)
    for _ in range(rounds):
        yes = np.log(prior) + bits @ np.log(hit) + (1 - bits) @ np.log(1 - hit)
        no = np.log(1 - prior) + bits @ np.log(false) + (1 - bits) @ np.log(1 - false)
        post = 1 / (1 + np.exp(np.clip(no - yes, -50, 50)))
        a, b = counts * post, counts * (1 - post)
        # two more of each vote: rates stay inside (0, 1)
        prior = float(np.clip((a.sum() + 2 * 0.7) / (counts.sum() + 2), 0.01, 0.99))
        hit = (a @ bits + 2 * np.array([0.9, 0.8, 0.4, 0.8, 0.4])) / (a.sum() + 2)
        false = (b @ bits + 2 * np.array([0.2, 0.3, 0.1, 0.5, 0.2])) / (b.sum() + 2)
    return prior, hit, false, post


def _logistic(bits: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights (last: constant) of a ridge logistic model of soft targets, by Newton's method."""
    x = np.hstack([bits, np.ones((len(bits), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - target)) + w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1])
        w -= np.linalg.solve(h, g)
    return w


def fit(found: DataFrame) -> dict[int, np.ndarray]:
    """A probability for each pattern of votes and form, a kind, by EM on the votes and the classifier trained on its posteriors.

    The classifier sees the form but no base vote: it must tell from the other evidence what EM believes.
    """
    n, forms = len(LABELERS), len(FORMS)
    table = np.zeros((len(KINDS), 2 ** (n + forms)))
    spans = found.select(F.explode("found").alias("x")).groupBy("x.kind", "x.votes").count()
    for r in spans.collect():  # at most kinds * 2 ** (labelers + forms) rows
        table[r["kind"], r["votes"]] = r["count"]
    bits = (np.arange(2 ** (n + forms))[:, None] >> np.arange(n + forms)) & 1
    seen = bits[:, 1:]
    out = {}
    for k in range(len(KINDS)):
        *_, post = em(table[k].reshape(2**forms, 2**n).sum(0))
        w = _logistic(seen, np.tile(post, 2**forms), table[k])
        out[k] = 1 / (1 + np.exp(-np.clip(seen @ w[:-1] + w[-1], -30, 30)))
    return out


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", add: float = ADD) -> DataFrame:
    """doc_id and found: all final spans of each document as (kind, start, end, votes, base), by kind, then start."""

    def run(batches):
        import pyarrow as pa

        kinds = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [[dict(zip(("kind", "start", "end", "votes"), c)) for c in candidates(t)] if t else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kinds)], names=["doc_id", "found"])

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    found = C.materialize(chosen.mapInArrow(run, f"doc_id {kind}, found array<struct<kind:int,start:int,end:int,votes:int>>"), "pii")
    chance = fit(found)
    table = F.array(*[F.array(*[F.lit(float(p)) for p in chance[k]]) for k in range(len(KINDS))])
    base = lambda x: x["votes"].bitwiseAND(1) == 1
    kept = F.filter("found", lambda x: base(x) | (F.get(F.get(table, x["kind"]), x["votes"]) >= add))
    return found.select("doc_id", F.array_sort(F.transform(kept, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), base(x).alias("base")))).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """The counts and texts of spans(): n_email, n_ip, n_card, n_phone and base_sha256 of base spans, spans of all."""
    names = F.array(*[F.lit(k) for k in KINDS])
    base = F.filter("found", lambda x: x["base"])
    said = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    of = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("found")).alias("spans"))
