"""Personal data by weak supervision.

Regular expressions, some looser than the base ones, propose candidate spans.
Labelers vote on each (yes, no, silent): the strict pattern, a check of the
value's form, gazetteers, cue words in the context, the border.  Candidates
with equal kind, votes and features count together, so the corpus comes down
to a table of at most ``SIGNATURES`` counts, over all candidates of all
documents.  Expectation-maximisation on these counts estimates how reliable
each labeler is and how likely each vote pattern is a true span; a logistic
regression on the features, fitted to these likelihoods, is the final
classifier.  Base spans always stay; a looser candidate becomes a span when
the classifier gives it ``ACCEPT`` or more and it meets no base span.

Texts are read once: candidates are written without their text, and the
model, a few dozen numbers, decides on that table.

Defined results: NULL text is empty; a document without spans has the digest
of the empty string and an empty ``spans``; rows equal in all columns stay;
an empty table gives an empty result (the model falls back to its priors);
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

KINDS = ("email", "ip", "card", "phone")
LABELERS = 5
FEATURES = (4, 4, 3, 2, 3)  # values of each feature: length, share of digits, separators, cue, border
SIGNATURES = len(KINDS) * 3**LABELERS * int(np.prod(FEATURES))
ACCEPT = 0.9
CONTEXT = 40
_BATCH = 500  # texts in Python at a time

# fixed values: the base patterns
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# looser ones
_LOOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[(] ?(?:dot|DOT) ?[\])] ?)[A-Za-z0-9-]{1,63})+"),
    "ip": re.compile(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9]{4}(?:[./][0-9]{4}){2}[./][0-9]{1,7}"),
    "phone": re.compile(r"(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}|00[1-9][0-9]{1,2}(?:[ .-][0-9]{2,4}){2,4}"),
}
_MAY = {"email": re.compile(r"[\[(] ?(?:at|AT)"), "ip": re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f]|\[\.\]"),
        "card": re.compile(r"[0-9]{4}[./][0-9]{4}"), "phone": re.compile(r"[0-9][.-][0-9]{3}|\) ?[0-9]{3}|00[1-9]")}

# fixed values: gazetteers and cue words
_DOMAINS = frozenset("com org net edu gov mil int info biz io co de fr es it uk us ca au nl se no fi dk pl ch at be jp cn in br ru eu".split())
_CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "36", "38", "6011", "65", "35", "2221", "50", "62")
_CUES = {"email": r"e-?mail|mailto|contact|correo|courriel", "ip": r"\bip\b|ipv[46]|host|server|address|addr",
         "card": r"card|visa|master|credit|debit|payment|karte|tarjeta|carte", "phone": r"phone|tel\b|tel[.:]|call|fax|mobile|telefon|tél"}
_CUES = {k: re.compile(v, re.I) for k, v in _CUES.items()}
_AGAINST = re.compile(r"version|isbn|issn|order|invoice|ref\b|sku|serial|\bv$|build|doi", re.I)
_DIGITS = re.compile(r"[0-9]")

Span = tuple[int, int, int, bool]  # start, kind, end, base


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Base spans by start, then kind: each kind leftmost and not overlapping."""
    out = []
    at, used = text.find("@"), 0
    while at >= 0:
        start = at
        while start > used and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            used = m.end()
            out.append((start, 0, used, True))
        at = text.find("@", max(at + 1, used))
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if m[1] and all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end(), True))
        for m in _CARD.finditer(text):
            digits = re.sub("[ -]", "", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end(), True))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                out.append((m.start(), 3, m.end(), True))
    return sorted(out)


def candidates(text: str) -> list[Span]:
    """Base spans, and looser matches that meet none of them."""
    base = base_spans(text)
    taken = sorted((s, e) for s, _, e, _ in base)
    starts = [s for s, _ in taken]
    reach = np.maximum.accumulate([e for _, e in taken]).tolist() if taken else []
    more = []
    for k, kind in enumerate(KINDS):
        for m in _LOOSE[kind].finditer(text) if _MAY[kind].search(text) else ():
            before = bisect_right(starts, m.end() - 1) - 1
            if before < 0 or reach[before] <= m.start():
                more.append((m.start(), k, m.end(), False))
    return sorted(base + more)


def signature(text: str, span: Span) -> int:
    """Kind, votes and features of a candidate as one number."""
    start, k, end, base = span
    kind, value = KINDS[k], text[span[0]:span[2]]
    digits = "".join(_DIGITS.findall(value))
    context = text[max(0, start - CONTEXT):start]
    cue = bool(_CUES[kind].search(context))
    outside = [c for c in (text[start - 1:start], text[end:end + 1]) if c]
    border = 2 if any(c.isalnum() for c in outside) else 1 if any(c in "-_/.@#" for c in outside) else 0
    if kind == "email":
        form = 1 if value.count("@") == 1 or not base else -1
        known = 1 if re.split(r"[^A-Za-z0-9-]+", value.rstrip(")] "))[-1].lower() in _DOMAINS else -1
    elif kind == "ip":
        form = -1 if any(len(p) > 1 and p[0] == "0" for p in value.split(".")) else 1
        known = 1 if ":" in value or 0 < int(digits[:3] or 0) else 0
    elif kind == "card":
        form = 1 if luhn(digits) else -1
        known = 1 if digits.startswith(_ISSUERS) else -1
    else:
        form = 1 if 9 <= len(digits) <= 15 or len(digits) == 10 else -1
        code = digits.removeprefix("00") if digits.startswith("00") else digits if value[0] == "+" else "1"
        known = 1 if any(code.startswith(x) for x in (code[:1], code[:2]) if x in _CALLING) else -1
    votes = (int(base), form, known, 1 if cue else -1 if _AGAINST.search(context) else 0, -1 if border == 2 else 1)
    share = 4 * len(digits) // max(1, len(value))
    separators = len(set(re.sub("[A-Za-z0-9]", "", value)))
    shape = (min(3, len(value) // 8), min(3, share), min(2, separators), int(cue), border)
    code = k
    for v in votes:
        code = code * 3 + v + 1
    for x, n in zip(shape, FEATURES):
        code = code * n + x
    return code


def unpack(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds, votes and features of signatures."""
    rest, shape, votes = np.asarray(codes, np.int64).copy(), [], []
    for n in reversed(FEATURES):
        shape.append(rest % n)
        rest //= n
    for _ in range(LABELERS):
        votes.append(rest % 3 - 1)
        rest //= 3
    flat = np.zeros((len(rest), 0))
    return rest, np.stack(votes[::-1], 1) if len(rest) else flat, np.stack(shape[::-1], 1) if len(rest) else flat


def reliabilities(kinds: np.ndarray, votes: np.ndarray, counts: np.ndarray, rounds: int = 50):
    """EM, each kind on its own: the likelihood that each vote pattern is a
    true span, and P(vote | true or not) by kind and labeler.  Starts from the
    majority vote."""
    likely, tables = np.zeros(len(counts)), {}
    for k in np.unique(kinds):
        own = kinds == k
        v, n = votes[own] + 1, counts[own].astype(float)
        p = np.clip(0.5 + 0.2 * votes[own].sum(axis=1), 0.05, 0.95)
        for _ in range(rounds):
            prior = np.clip((p * n).sum() / n.sum(), 0.02, 0.98)
            table = np.stack([[np.bincount(v[:, j], w * n, 3) + 1 for w in (1 - p, p)] for j in range(LABELERS)])
            table /= table.sum(axis=2, keepdims=True)
            log = np.log([1 - prior, prior]) + sum(np.log(table[j][:, v[:, j]]).T for j in range(LABELERS))
            p = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        likely[own], tables[int(k)] = p, table
    return likely, tables


def _design(kinds: np.ndarray, shape: np.ndarray) -> np.ndarray:
    parts = [np.eye(len(KINDS))[kinds]]
    for j, n in enumerate(FEATURES):
        parts.append(np.eye(n)[shape[:, j].astype(int)])
    return np.concatenate(parts, axis=1)


def fit(codes: np.ndarray, counts: np.ndarray, rounds: int = 30, ridge: float = 0.1) -> np.ndarray:
    """Weights of the span classifier (Newton steps on the weighted ridge loss)."""
    width = len(KINDS) + sum(FEATURES)
    weights = np.zeros(width)
    if not len(codes):
        return weights
    kinds, votes, shape = unpack(codes)
    likely, _ = reliabilities(kinds, votes, counts)
    x, n = _design(kinds, shape), counts.astype(float)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (n * (p - likely)) + ridge * weights
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(width)
        weights = weights - np.linalg.solve(bend, slope)
    return weights


def accepted(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    kinds, _, shape = unpack(codes)
    if not len(kinds):
        return np.zeros(0, bool)
    return 1 / (1 + np.exp(-np.clip(_design(kinds, shape) @ weights, -30, 30))) >= ACCEPT


_FOUND = "doc_id long, starts array<int>, kinds array<int>, ends array<int>, base array<boolean>, codes array<int>"


def _find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for a in range(0, len(batch), _BATCH):
            part = batch.iloc[a:a + _BATCH]
            found = [[(*s, signature(t, s)) for s in candidates(t)] if t else [] for t in part["text"]]
            out = pd.DataFrame({"doc_id": part["doc_id"]})
            for j, name in enumerate(("starts", "kinds", "ends", "base", "codes")):
                out[name] = [[x[j] for x in f] for f in found]
            yield out


def _digest(weights: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                good = accepted(np.asarray(r.codes, np.int64), weights)
                spans = list(zip(r.starts, r.kinds, r.ends, r.base, good))
                base = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, b, _ in spans if b)
                every = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, b, g in spans if b or g)
                rows.append((r.doc_id, *(sum(1 for x in spans if x[3] and x[1] == k) for k in range(4)),
                             hashlib.sha256(base.encode()).hexdigest(), every))
            yield pd.DataFrame(rows, columns=_COLUMNS).astype({"doc_id": batch["doc_id"].dtype})
    return run


_COLUMNS = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def find_candidates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Candidates of every document with their signatures, written once."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return materialize(narrow.mapInPandas(_find, _FOUND))


def train(found: DataFrame) -> np.ndarray:
    """The classifier's weights from the counts of all signatures."""
    counts = found.select(F.explode("codes").alias("code")).groupBy("code").count().toPandas().sort_values("code")
    return fit(counts["code"].to_numpy(), counts["count"].to_numpy())


def personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, counts of base spans, ``base_sha256``, ``spans``."""
    found = find_candidates(docs, text, doc_id)
    return found.mapInPandas(_digest(train(found)), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                                                    "base_sha256 string, spans string")
