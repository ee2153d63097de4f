"""Personal data: weak labelers vote on spans, expectation-maximisation weighs them, a classifier decides."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, table, with_key

KINDS = ("email", "ip", "card", "phone")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Wider forms that the strict patterns miss.
WIDER = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?[\[(](?:at|AT)[\])]\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|[\[(](?:dot|DOT)[\])])\s?[A-Za-z0-9-]{1,63}){1,4}")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("phone", re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\s?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9-])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?![0-9])")),
)
SEED = re.compile(r"[0-9@]|[\[(](?:at|AT)[\])]|(?:[0-9A-Fa-f]{1,4}:){7}")

#: Gazetteers: fixed values that tell real addresses, issuers and country codes from look-alikes.
TOP_LEVEL = frozenset("com org net edu gov mil int info biz io ai app dev co us uk de fr es it nl be ch at se no dk fi pl pt ie eu ru cn jp kr in br mx ar ca au nz za".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "2221", "2720", "34", "37", "36", "38", "6011", "65", "35", "62")
COUNTRIES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "64", "81", "82", "86", "90", "91", "351", "353", "358", "420")

#: Words before a span that speak for its kind, and words that speak against any kind.
FOR = {
    "email": re.compile(r"mail|contact|write|correo|courriel|kontakt", re.IGNORECASE),
    "ip": re.compile(r"\bip\b|host|server|addr|login|client", re.IGNORECASE),
    "card": re.compile(r"card|visa|master|credit|tarjeta|carte|karte|pay", re.IGNORECASE),
    "phone": re.compile(r"tel|phone|call|fax|mobile|movil|handy|whatsapp", re.IGNORECASE),
}
AGAINST = re.compile(r"token|secret|key|hash|sha|version|isbn|order|invoice|\bid\b|[=#/\\]\s?\"?$", re.IGNORECASE)
NEAR = 24

LABELERS = ("strict", "shape", "gazetteer", "context", "check", "edges")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def octet(digits: str) -> bool:
    """Whether a run of digits is at most 255; the run may be of any length, so it is never made a number whole."""
    value = digits.lstrip("0")
    return len(value) < 3 or len(value) == 3 and value <= "255"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost non-overlapping emails: each `@` with the run before it and a domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", m.end() if m else at + 1)


def strict_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the spans that the fixed patterns and their checks accept, in order."""
    found = [(s, 0, e) for s, e in emails(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(octet, m[0].split(".")))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(found)


def wider_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of spans of WIDER that overlap no span of `taken`, nor each other."""
    found = sorted((m.start(), KINDS.index(kind), m.end()) for kind, pattern in WIDER for m in pattern.finditer(text))
    out, i, end = [], 0, -1
    for s, k, e in found:
        while i < len(taken) and max(end, taken[i][2]) <= s and taken[i][0] <= s:
            i += 1
        if s >= end and not any(a < e and s < b for a, _, b in taken[max(0, i - 2) : i + 8]):
            out.append((s, k, e))
            end = e
    return out


def votes(text: str, start: int, kind: int, end: int, strict: bool) -> tuple[int, ...]:
    """Each labeler's vote on a span: 1 for, -1 against, 0 none; then the span's length class."""
    span, digits = text[start:end], digits_of(text[start:end])
    before = text[max(0, start - NEAR) : start]
    edges = (text[start - 1 : start] + text[end : end + 1]).strip()
    if kind == 0:
        plain = re.sub(r"\s?[\[(](?:dot|DOT)[\])]\s?", ".", re.sub(r"\s?[\[(](?:at|AT)[\])]\s?", "@", span))
        shape = 1 if re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", plain) else -1
        gazetteer = 1 if re.split(r"[^A-Za-z]+", span.rstrip(")]"))[-1].lower() in TOP_LEVEL else -1
        check = 1 if ".." not in span else -1
    elif kind == 1:
        parts = span.split(".")
        shape = 1 if len(parts) == 4 and all(x == "0" or x[0] != "0" for x in parts) or ":" in span else -1
        gazetteer = -1 if span.startswith(("0.", "255.")) else 1
        check = 1 if ":" in span or all(map(octet, parts)) else -1
    elif kind == 2:
        shape = 1 if re.fullmatch(r"[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}", span) else -1
        gazetteer = 1 if digits.startswith(ISSUERS) else -1
        check = 1 if luhn(digits) else -1
    else:
        shape = 1 if re.fullmatch(r"(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}", span) else -1
        gazetteer = (1 if digits.startswith(COUNTRIES) else -1) if span.startswith("+") else 0
        check = 1 if 10 <= len(digits) <= 15 else -1
    context = 1 if FOR[KINDS[kind]].search(before) else -1 if AGAINST.search(before) else 0
    return (1 if strict else 0, shape, gazetteer, context, check, -1 if any(c.isalnum() for c in edges) else 1, min(3, len(span) // 8))


def candidates(text: str | None) -> list[tuple[int, int, int, bool]]:
    """(start, kind number, end, strict) of all spans that the labelers vote on."""
    if not text or not SEED.search(text):
        return []
    strict = strict_spans(text)
    return [(*x, True) for x in strict] + [(*x, False) for x in wider_spans(text, strict)]


def pattern_batches(batches):
    """A mapInArrow function over (text) that gives (pattern, n): how often labelers voted so on a kind."""
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for s, k, e, strict in candidates(text):
                counts[(k, *votes(text, s, k, e, strict))] += 1
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array([list(p) for p in counts], pa.list_(pa.int32())), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"])


class Reliabilities:
    """What each labeler votes on true and on false spans of a kind, by expectation-maximisation.

    A span's truth is hidden. Votes are taken as independent given the truth; the first guess is the
    majority of votes.
    """

    def __init__(self, patterns: np.ndarray, n: np.ndarray, rounds: int = 50):
        kinds, v = patterns[:, 0], patterns[:, 1 : 1 + len(LABELERS)] + 1
        self.truth = 1 / (1 + np.exp(-patterns[:, 1 : 1 + len(LABELERS)].sum(axis=1).astype(float)))
        one_hot = np.eye(3)[v]
        self.tables = {}
        for k in np.unique(kinds):
            own = kinds == k
            p, w, x = self.truth[own], n[own].astype(float), one_hot[own]
            for _ in range(rounds):
                true, false = w * p, w * (1 - p)
                table_true = (np.einsum("s,slv->lv", true, x) + 0.5) / (true.sum() + 1.5)
                table_false = (np.einsum("s,slv->lv", false, x) + 0.5) / (false.sum() + 1.5)
                prior = (true.sum() + 2) / (w.sum() + 3)
                odds = np.log(prior / (1 - prior)) + np.einsum("slv,lv->s", x, np.log(table_true / table_false))
                p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            # Should the classes have changed places, the one that strict spans are in is the true one.
            if np.average(p, weights=w * (v[own][:, 0] == 2) + 1e-9) < 0.5:
                p, table_true, table_false = 1 - p, table_false, table_true
            self.truth[own] = p
            self.tables[KINDS[k]] = (table_true, table_false)


def design(patterns: np.ndarray) -> np.ndarray:
    """Features of the span classifier: kind, each labeler's vote, and length class, one-hot."""
    columns = [np.eye(len(KINDS))[patterns[:, 0]]]
    columns += [np.eye(3)[patterns[:, 1 + i] + 1] for i in range(len(LABELERS))]
    columns.append(np.eye(4)[patterns[:, 1 + len(LABELERS)]])
    return np.hstack(columns)


class SpanClassifier:
    """Logistic regression on the labelers' votes, trained on the probabilities that EM gave."""

    def __init__(self, patterns: np.ndarray, truth: np.ndarray, n: np.ndarray, penalty: float = 1.0, steps: int = 30):
        x = design(patterns)
        w = np.zeros(x.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (n * (truth - p)) - penalty * w
            bend = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty * np.eye(len(w))
            w += np.clip(np.linalg.solve(bend, slope), -2, 2)
        self.weights = w

    def probability(self, patterns: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(design(patterns) @ self.weights, -30, 30)))


def learned(texts: DataFrame) -> tuple[SpanClassifier | None, Reliabilities | None]:
    """The classifier and reliabilities for `texts` (text).

    Only counts of distinct vote patterns leave the cluster: at most 4 kinds x 3 ** 6 votes x 4 lengths
    = 11,664 of them, however many texts there are.
    """
    rows = texts.mapInArrow(pattern_batches, "pattern array<int>, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    if not rows:
        return None, None
    rows.sort(key=lambda r: r.pattern)
    patterns, n = np.array([r.pattern for r in rows]), np.array([r.n for r in rows], float)
    found = Reliabilities(patterns, n)
    return SpanClassifier(patterns, found.truth, n), found


SPANS = f"{KEY} long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def span_batches(model):
    """A mapInArrow function over (KEY, text) that gives SPANS."""

    def find(batches):
        classifier, known = model.value, {}
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, more = [], []
                for s, k, e, strict in candidates(text):
                    if strict:
                        base.append((s, k, e))
                        continue
                    pattern = (k, *votes(text, s, k, e, strict))
                    if pattern not in known:
                        known[pattern] = bool(classifier.probability(np.array([pattern]))[0] >= 0.5)
                    if known[pattern]:
                        more.append((s, k, e))
                kinds = Counter(k for _, k, _ in base)
                out.append((key, *(kinds[i] for i in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(base) + len(more)))
            kinds = (*(pa.int64(),) * 5, pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 7, kinds, strict=True)], [KEY, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    return find


def personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """SPANS of `docs` (with KEY): counts of strict spans, their digest, all spans found and their number.

    Strict spans are always kept; spans of wider forms are added where the classifier finds them
    likelier true than not. Null and empty texts have no spans.
    """
    texts = docs.select(KEY, F.col(text_col).cast("string").alias("text"))
    classifier, _ = learned(texts.select("text"))
    model = docs.sparkSession.sparkContext.broadcast(classifier)
    return texts.mapInArrow(span_batches(model), SPANS)


def op4_pii(spark, sf_dir):
    """The spans of every document; n_spans counts those that the classifier added, too."""
    docs = with_key(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    found = personal_data(docs).join(docs.select(KEY, "doc_id"), KEY)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans")
