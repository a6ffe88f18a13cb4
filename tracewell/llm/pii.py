"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation estimates how far each is to be trusted, and a classifier
trained on the outcome decides which candidates are spans beside the base ones."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

#: The kinds with base patterns, and those that the method alone finds.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
#: A candidate becomes a span if the classifier gives it this probability and this many labelers speak for it.
ACCEPT, VOICES = 0.9, 2
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Looser shapes of the same kinds.
_LOOSE = {
    0: re.compile(r"\b[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z0-9-]{2,24}){1,3}\b"),
    1: re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    2: re.compile(r"(?<![0-9])[0-9]{4}(?:[./_ -][0-9]{4}){3}(?![0-9])"),
    3: re.compile(r"(?<![0-9+])(?:\([0-9]{2,4}\)|0[0-9]{1,4})[ ./-]?[0-9]{2,4}(?:[ ./-][0-9]{2,4}){1,3}(?![0-9])"),
    4: re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"),
}
#: Gazetteers: fixed values.
_TLDS = frozenset("com org net edu gov info biz io co uk de fr es it nl eu us ca au jp ch at be pl se".split())
_ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "38")
_CALLING = ("+1", "+33", "+34", "+39", "+44", "+49", "+31", "+41", "+43", "+61", "+81", "+86", "+91")
_CONTEXT = (
    re.compile(r"\b(?:e-?mail|mail|write to|contact|correo|courriel|reach)\b", re.I),
    re.compile(r"\b(?:ip|address|host|server|login|logged)\b", re.I),
    re.compile(r"\b(?:card|visa|mastercard|amex|credit|payment|carte|tarjeta|karte)\b", re.I),
    re.compile(r"\b(?:phone|tel|telephone|call|mobile|cell|fax|sms|telefon|tél|teléfono)\b", re.I),
)
#: Of secrets: names that a value follows, words around, names of values that are public, and shapes that credentials have.
_KEYS = re.compile(r"\b(?:[a-z]{0,16}[_-]?(?:token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer))\b[\"']?\s{0,3}(?:=|:|=>)?\s{0,3}[\"']?$", re.I)
_CREDENTIAL = re.compile(r"\b(?:token|secret|password|passwd|credential|credentials|login|key|bearer|auth|authorization|api)\b", re.I)
_PUBLIC = re.compile(r"\b(?:commit|sha-?(?:1|256|512)?|md5|checksum|digest|etag|uuid|hash|build|rev|revision|fingerprint|version|isbn|order|sku)\b[\"']?\W{0,4}$", re.I)
_SHAPE = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|[sp]k_[A-Za-z0-9_]{16,}|xox[abp]-[A-Za-z0-9-]{10,})")
_AGAINST = re.compile(r"\b(?:isbn|version|order|sku|part|token|hash|id|no|nr|serial|build)\b\W*$", re.I)


def luhn(digits: str) -> bool:
    """Whether the digits' check sum holds: each second digit from the right counts twice, less 9 if over 9."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start. The patterns are met from where alone they can match, so that no text takes more than linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and (c := text[lo - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, lo, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """The base spans, and looser ones that overlap none of them; of secrets, runs that mix letters and digits."""
    base = base_spans(text)
    out = [(*s, True) for s in base]
    low = text.lower() if " at " in text or "(at)" in text or "[at]" in text else ""
    starts, ends, end = [], [], 0
    for _, a, b in sorted(base, key=lambda s: s[1]):  # of their union
        if starts and a <= end:
            ends[-1] = end = max(end, b)
        else:
            starts.append(a)
            ends.append(end := b)
    for kind, shape in _LOOSE.items():
        if kind == 0 and " dot " not in low and "(at)" not in low and "[at]" not in low:
            continue
        for m in shape.finditer(text):
            k = bisect_left(starts, m.end()) - 1  # the last that begins before the match ends
            if (k < 0 or ends[k] <= m.start()) and (kind != 4 or re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])):
                out.append((kind, m.start(), m.end(), False))
    return out


def bits(text: str) -> float:
    """Shannon's entropy of the characters."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def votes(text: str, kind: int, start: int, end: int, base: bool) -> tuple[int, ...]:
    """Of each labeler: 1 for personal data, 0 against, 2 for no vote. Pattern, gazetteer, words around, check of the characters, and what stands directly before."""
    span, before = text[start:end], text[max(0, start - 40) : start]
    around = before + " " + text[end : end + 20]
    if kind == 4:
        known = 1 if _KEYS.search(before) else 2
        rate = bits(span)
        return 1 if _SHAPE.fullmatch(span) else 2, known, 1 if _CREDENTIAL.search(around) else 2, 1 if rate >= 3 else 0, 0 if _PUBLIC.search(before) else 2
    digits = "".join(c for c in span if c.isdigit() and c.isascii())
    if kind == 0:
        known = 1 if re.split(r"[\s.()\[\]]+", span.lower())[-1] in _TLDS else 0
    elif kind == 2:
        known = 1 if digits.startswith(_ISSUERS) else 0
    elif kind == 3:
        known = 1 if span.startswith(_CALLING) else 2
    else:
        known = 0 if span.startswith(("0.", "127.", "255.")) else 2
    context = 1 if _CONTEXT[kind].search(around) else 2
    if kind == 2:
        check = int(luhn(digits))
    elif kind == 3:
        check = 0 if not 9 <= len(digits) <= 15 or len(set(digits)) < 3 else 2
    else:
        check = 2
    return 1 if base else 2, known, context, check, 0 if _AGAINST.search(before) else 2


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("pattern", pa.int32())]))
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            found = []
            for kind, a, b, base in candidates(text or ""):
                v = votes(text, kind, a, b, base)
                sides = (a > 0 and text[a - 1].isalnum()) * 1 + (b < len(text) and text[b].isalnum()) * 2 + (b - a > 24) * 4 + (a == 0 or text[a - 1] == "\n") * 8
                found.append({"kind": kind, "start": a, "end": b, "base": base, "pattern": (((kind * 243 + sum(x * 3**k for k, x in enumerate(v))) << 4) | sides)})
            out.append(sorted(found, key=lambda s: (s["start"], s["kind"], s["end"])))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, span)], ["doc_id", "spans"])


def unpack(pattern: int) -> tuple[int, list[int], list[int]]:
    """Kind, votes and shape of a pattern."""
    code = pattern >> 4
    return code // 243, [code % 243 // 3**k % 3 for k in range(5)], [pattern >> k & 1 for k in range(4)]


def reliabilities(kinds: np.ndarray, v: np.ndarray, n: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Probability of each pattern to be personal data. By kind: the chance of each vote given the truth, and of the truth, by turns (two classes, votes
    independent given the class), begun from the majority."""
    out = np.zeros(len(n))
    for kind in np.unique(kinds):
        at = kinds == kind
        vote, weight = v[at], n[at].astype(float)
        p = (0.5 + (vote == 1).sum(1)) / (1.0 + (vote < 2).sum(1))
        for _ in range(rounds):
            share = (weight * p).sum() / weight.sum()
            log = np.tile(np.log([max(share, 1e-6), max(1 - share, 1e-6)]), (len(vote), 1))
            for j in range(vote.shape[1]):
                for side, q in enumerate((p, 1 - p)):
                    seen = np.bincount(vote[:, j], weight * q, 3) + (1.0 if side else np.array([0.5, 1.5, 1.0]))
                    log[:, side] += np.log(seen / seen.sum())[vote[:, j]]
            new = 1 / (1 + np.exp(np.clip(log[:, 1] - log[:, 0], -50, 50)))
            if np.abs(new - p).max() < 1e-6:
                break
            p = new
        out[at] = p
    return out


def train(counts: list[tuple[int, int]]) -> dict[int, float]:
    """A probability for each pattern, by logistic regression on its votes and shape towards the estimated truth. counts: (pattern, spans with it)."""
    if not counts:
        return {}
    names = np.array([c[0] for c in counts])
    n = np.array([c[1] for c in counts], float)
    parts = [unpack(int(x)) for x in names]
    kinds, v, shape = np.array([x[0] for x in parts]), np.array([x[1] for x in parts]), np.array([x[2] for x in parts], float)
    target = reliabilities(kinds, v, n)
    x = np.hstack([np.eye(len(ALL_KINDS))[kinds], (v[:, :, None] == np.arange(3)).reshape(len(v), -1).astype(float), shape])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x.T * (n * p * (1 - p) + 1e-9)) @ x + np.eye(len(w)), x.T @ (n * (target - p)) - w)
    return dict(zip(names.tolist(), (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist(), strict=True))


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans of each row: kind (email, ip, card, phone or secret), start, end (code points, end exclusive), base and probability, by start and kind.

    Base spans always stay; others need the classifier. It learns from the number of spans of each pattern of votes, over all rows: a table of some thousands at
    most, whatever the input. Null and empty texts have no spans; a null doc_id stays null; rows that repeat are searched each, and each counts for the classifier.
    Other columns are not read."""
    shape = "doc_id long, spans array<struct<kind: int, start: int, end: int, base: boolean, pattern: int>>"
    found = save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_find, shape), "spans")
    counts = found.select(F.explode("spans.pattern").alias("p")).groupBy("p").count().collect()
    model = train([tuple(r) for r in counts])
    good = {p: q >= ACCEPT and unpack(p)[1].count(1) >= VOICES for p, q in model.items()}
    # one row that holds the model, met by a key that all rows have
    table = docs.sparkSession.createDataFrame([(0, {p: (round(q, 6), good[p]) for p, q in model.items()})], "one int, model map<int, struct<chance: double, good: boolean>>")
    of = lambda s: F.try_element_at("model", s["pattern"])
    name = lambda s: F.element_at(F.array(*map(F.lit, ALL_KINDS)), s["kind"] + 1)
    told = found.withColumn("one", F.lit(0)).join(F.broadcast(table), "one")
    stay = F.filter("spans", lambda s: s["base"] | of(s)["good"])
    span = lambda s: F.struct(name(s).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), of(s)["chance"].alias("probability"))
    return told.select("doc_id", F.transform(stay, span).alias("spans"))


def redact(text: str | None, spans: list) -> str:
    """The text with each span's kind in brackets in its place; of spans that overlap the first stands for both."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [(text or "")[at : s["start"]], f"[{s['kind']}]"]
        at = max(at, s["end"])
    return "".join([*out, (text or "")[at:]])


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """find_spans over all documents, the base ones also by kind; nulls, empties and repeated rows as there."""
    found = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["base"])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = [F.size(F.array_compact(F.transform(base, lambda s: F.when(s["kind"] == F.lit(k), 1)))).cast("long").alias(f"n_{k}") for k in KINDS]  # noqa: B023
    return found.select("doc_id", *count, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
