"""Quality classifier: a regularised quadratic discriminant over document statistics."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, durable, table, with_key, without

#: Share of the pooled covariance in each class covariance, and of the scaled identity after that.
POOLED, RIDGE = 0.9, 0.02

UPPER = bytes(range(0x41, 0x5B))
DIGITS = bytes(range(0x30, 0x3A))
STOPS = b".,;:?!'\"-()"
SYMBOLS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c not in STOPS)
HIGH = bytes(range(0x80, 0x100))

FEATURES = (
    "log_words", "log_word_bytes", "upper", "digits", "stops", "symbols", "high", "unique_words", "unique_pairs",
    "unique_lines", "log_line_words", "shouted", "short_words", "top_word", "ended_lines", "bangs",
)


def statistics(text: bytes | None) -> list[float]:
    """The transformed FEATURES of a text: logarithms of sizes, square roots of shares.

    Null, empty and blank texts have size 0 and all shares 0 or, where a share of distinct things is
    meant, 1.
    """
    text = text or b""
    n = len(text) + 1
    share = lambda chars: (len(text) - len(text.translate(None, chars))) / n
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    k, m = max(1, len(words)), max(1, len(lines))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = set(zip(words, words[1:]))
    root = math.sqrt
    return [
        math.log1p(len(words)), math.log1p(sum(map(len, words)) / k), root(share(UPPER)), root(share(DIGITS)), root(share(STOPS)), root(share(SYMBOLS)),
        root(share(HIGH)), len(counts) / k if words else 1.0, len(pairs) / (k - 1) if k > 1 else 1.0, len(set(lines)) / m if lines else 1.0,
        math.log1p(len(words) / m), root(sum(map(bytes.isupper, words)) / k), root(sum(c for w, c in counts.items() if len(w) < 4) / k),
        root(max(counts.values(), default=0) / k), root(sum(x.rstrip().endswith((b".", b"?", b"!")) for x in lines) / m), root(share(b"!")),
    ]


def feature_batches(batches):
    """A mapInArrow function over (KEY, text as bytes) that gives KEY and the features x."""
    for batch in batches:
        x = [statistics(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], [KEY, "x"])


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.select(KEY, F.col(text_col).cast("binary").alias("text")).mapInArrow(feature_batches, f"{KEY} long, x array<double>")


class Discriminant:
    """Two Gaussian classes with shrunken covariances; keeps the inverse Cholesky factor of each."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = POOLED, ridge: float = RIDGE):
        """`moments`: for each class the number, sum and sum of outer products of its feature vectors."""
        d = len(FEATURES)
        total = sum(n for n, _, _ in moments.values())
        self.parts = {}
        if total == 0:
            return
        scatter = {c: q - np.outer(s, s) / n for c, (n, s, q) in moments.items() if n}
        common = sum(scatter.values()) / max(1.0, total - len(scatter))
        scale = np.sqrt(np.maximum(np.diag(common), 1e-12))
        for c, (n, s, _) in moments.items():
            if n:
                own = (1 - pooled) * scatter[c] / max(1.0, n - 1) + pooled * common
                own = own / np.outer(scale, scale)
                own = (1 - ridge) * own + ridge * max(np.trace(own) / d, 1e-6) * np.eye(d)
                factor = np.linalg.cholesky(own)
                prior = math.log((n + 1) / (total + 2))
                self.parts[c] = (s / n, np.linalg.inv(factor) / scale, prior - np.log(np.diag(factor)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 of each row; 0.5 where nothing was learned, its class where only one was."""
        if len(self.parts) < 2:
            return np.full(len(x), float(next(iter(self.parts))) if self.parts else 0.5)
        log = {c: base - 0.5 * np.square((x - mean) @ whiten.T).sum(axis=1) for c, (mean, whiten, base) in self.parts.items()}
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def moment_batches(batches):
    """A mapInArrow function over (label, x) that gives (label, i, value): moments of all its rows."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        labels = batch.column(0).to_numpy(zero_copy_only=False)
        x = np.array(batch.column(1).to_pylist(), float).reshape(len(labels), -1)
        for c in np.unique(labels):
            own = np.column_stack((np.ones((labels == c).sum()), x[labels == c]))
            sums[int(c)] = sums.get(int(c), 0) + own.T @ own
    for c, m in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([c] * m.size, pa.int32()), pa.array(range(m.size), pa.int32()), pa.array(m.ravel())], ["label", "i", "value"])


def train(labelled: DataFrame, pooled: float = POOLED, ridge: float = RIDGE) -> Discriminant:
    """A Discriminant from all rows of `labelled` (label 0 or 1, x); only summed moments reach the driver."""
    rows = labelled.select(F.col("label").cast("int"), "x").mapInArrow(moment_batches, "label int, i int, value double")
    d = len(FEATURES) + 1
    sums = {c: np.zeros(d * d) for c in (0, 1)}
    for r in rows.groupBy("label", "i").agg(F.sum("value").alias("value")).collect():
        sums[r.label][r.i] = r.value
    square = {c: m.reshape(d, d) for c, m in sums.items()}
    return Discriminant({c: (m[0, 0], m[0, 1:], m[1:, 1:]) for c, m in square.items()}, pooled, ridge)


def training_rows(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(label, x) of `rows` (id, x) with a label of 0 or 1 and not held out.

    A row is held out if the CRC-32 of its id as text leaves 1 when divided by 3. A label given twice
    counts once; where a document has both labels, both count.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter("label in (0, 1)").distinct()
    return rows.filter(~held_out("id", 3, 1)).join(known, "id").select("label", "x")


def held_out(id_col: str, parts: int, part: int):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def score_batches(model):
    def score(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(x))], [KEY, "score"])

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """KEY, id, held_out, score, predicted of each of `docs` (with KEY).

    Features are taken from whole texts in one pass and kept; labels are learned from the rows that are
    not held out; a few hundred sums make the model. Null ids are never held out and have no label.
    """
    ids = docs.select(KEY, F.col(id_col).alias("id"))
    x = durable(features(docs, text_col))
    model = docs.sparkSession.sparkContext.broadcast(train(training_rows(x.join(ids, KEY), labels, id_col)))
    scored = x.mapInArrow(score_batches(model), f"{KEY} long, score double")
    return scored.join(ids, KEY).select(KEY, "id", held_out("id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are predicted to have quality 1, with all their columns."""
    keyed = with_key(docs, id_col)
    return without(keyed, quality_scores(keyed, labels, id_col, text_col).filter("predicted = 0")).select(*docs.columns)


def op3_quality(spark, sf_dir):
    """The quality score of every document, learned from the labels of those that are not held out."""
    docs = with_key(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    scores = quality_scores(docs, table(spark, sf_dir, "labels"))
    return scores.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")
