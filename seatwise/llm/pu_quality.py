"""Quality scores by positive-unlabelled learning.

Only trusted positives and unlabelled text are learnt from: no negatives. The class prior of the
unlabelled text is estimated as the least ratio of unlabelled to positive mass above a threshold of a
first classifier that tells the two apart; then a logistic model minimises the non-negative unbiased
risk, prior * P(loss as positive) + max(0, U(loss as negative) - prior * P(loss as negative)).
The unlabelled are all rows: their means, deviations, masses and risks are sums over the table, made where
the rows are. Each whole text is read once, as counts of characters, words and lines.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatwise.llm.common import stage
from seatwise.llm.labelled import descend, ordered_ids, sigmoid

POSITIVES = 10_000
SEED = "quality-1"
STEPS = 40
ENOUGH = 1e-3
PENALTY = 1e-4
#: Confidence with which the masses of the prior's estimate are bounded.
DOUBT = 0.1

MARKS = [b".", b",", b"!", b"?", b":;", b"%", b"&", b"$", b"#", b"*", b"|", b"\"'`", b"()[]{}", b"@", b"/\\", b"-_", b"<>", b"+=~^"]
_GROUP = np.full(256, len(MARKS) + 6, dtype=np.int64)
for _k, _bytes in enumerate(MARKS):
    for _b in _bytes:
        _GROUP[_b] = _k
for _k, (_lo, _hi) in enumerate([(65, 90), (97, 122), (48, 57), (128, 255), (32, 32), (9, 13)]):
    _GROUP[_lo:_hi + 1] = len(MARKS) + _k
_UPPER, _LOWER, _DIGIT, _HIGH, _BLANK, _LINE, _OTHER = range(len(MARKS), len(MARKS) + 7)


def features(text: bytes) -> list[float]:
    """Rates of characters, words and lines of one whole text; zeros for a text without words."""
    words = text.split()
    if not words:
        return [0.0] * N_FEATURES
    data = np.frombuffer(text, dtype=np.uint8)
    kind = np.bincount(_GROUP[data], minlength=len(MARKS) + 7)
    last = np.bincount(_GROUP[np.frombuffer(b"".join([w[-1:] for w in words]), dtype=np.uint8)], minlength=len(MARKS) + 7)
    lines = [x for x in text.split(b"\n") if x.strip()]
    n, letters = len(words), max(1, int(kind[_UPPER] + kind[_LOWER]))
    count = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    return [float(np.log1p(n)), len(b"".join(words)) / n / 10, len(count) / n, max(count.values()) / n, pairs / n,
            kind[_UPPER] / letters, len(set(lines)) / len(lines), np.log1p(n / len(lines)),
            sum(len(w) == 1 for w in words) / n, np.log1p(max(map(len, words))) / 5,
            *np.sqrt(kind / len(text)), *np.sqrt(last / n)]


N_FEATURES = 10 + 2 * (len(MARKS) + 7)


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(expanded((x - self.centre) / self.scale) @ self.weights)


def expanded(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -4, 4)
    return np.column_stack([x, x ** 2, np.ones(len(x))])


def class_prior(at: np.ndarray, mass_p: np.ndarray, mass_u: np.ndarray, n_p: int, n_u: int) -> float:
    """The share of positives among the unlabelled, from both masses at and above each score of ``at``.

    Scores are higher for positives. Above any threshold the unlabelled mass is at least prior times the
    positive mass; the threshold at which this bounds the prior best, with both masses' sampling doubt,
    gives the estimate.
    """
    doubt = np.sqrt(np.log(4 / DOUBT) / 2 / n_p) + np.sqrt(np.log(4 / DOUBT) / 2 / n_u)
    best = int(((mass_u + doubt) / mass_p).argmin())
    return float(np.clip(mass_u[best] / mass_p[best], 0.01, 0.99))


def _summed(rows: DataFrame, work: Callable[[np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """The sum over all rows' feature matrices of the ``n`` numbers that ``work`` makes of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
            if len(x):
                total += work(x)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["k", "v"])

    out = np.zeros(n)
    for r in rows.select("x").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # n rows at most
        out[r["k"]] = r["v"]
    return out


def spread(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and deviation of each feature over all rows (1 where it does not vary), and how many rows there are."""
    sums = _summed(rows, lambda x: np.concatenate((x.sum(axis=0), [len(x)])), N_FEATURES + 1)
    n = int(sums[-1])
    centre = sums[:-1] / max(1, n)
    scale = np.sqrt(_summed(rows, lambda x: ((x - centre) ** 2).sum(axis=0), N_FEATURES) / max(1, n))
    return centre, np.where(scale > 1e-9, scale, 1.0), n


def masses(rows: DataFrame, at: np.ndarray, score: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """How many rows have at least each score of ``at`` (ascending)."""
    counts = _summed(rows, lambda x: np.bincount(np.searchsorted(at, score(x), side="right"), minlength=len(at) + 1).astype(float), len(at) + 1)
    return counts[::-1].cumsum()[::-1][1:]


def learn(positive: np.ndarray, rows: DataFrame) -> Model:
    """The model of the positives' feature rows, and of all ``rows`` as the unlabelled ones."""
    centre, scale, n_u = spread(rows)

    def placed(x: np.ndarray) -> np.ndarray:
        return expanded((x - centre) / scale)

    p = placed(positive)
    width = p.shape[1]

    def as_negatives(w: np.ndarray) -> tuple[np.ndarray, float]:
        """Gradient and value of the unlabelled rows' mean loss as negatives."""
        def work(x: np.ndarray) -> np.ndarray:
            u = placed(x)
            z = u @ w
            return np.concatenate((u.T @ sigmoid(z), [np.logaddexp(0, z).sum()]))
        sums = _summed(rows, work, width + 1) / n_u
        return sums[:-1], sums[-1]

    def apart(w: np.ndarray) -> np.ndarray:
        return p.T @ (sigmoid(p @ w) - 1) / len(p) + as_negatives(w)[0] + PENALTY * w

    w = descend(apart, np.zeros(width), STEPS, ENOUGH)
    at = np.unique(p @ w)
    mass_p = 1 - np.searchsorted(np.sort(p @ w), at, side="left") / len(p)
    prior = class_prior(at, mass_p, masses(rows, at, lambda x: placed(x) @ w) / n_u, len(p), n_u)

    def risk(w: np.ndarray) -> np.ndarray:
        at_p = p @ w
        gradient, loss = as_negatives(w)
        out = prior * (p.T @ (sigmoid(at_p) - 1)) / len(p) + PENALTY * w
        if loss - prior * np.logaddexp(0, at_p).mean() >= 0:  # below 0 the negatives' risk counts as 0
            out += gradient - prior * (p.T @ sigmoid(at_p)) / len(p)
        return out

    return Model(centre, scale, descend(risk, np.zeros(width), STEPS, ENOUGH), prior)


def described(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: the features of each row."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return rows.mapInArrow(run, f"doc_id {kind}, x array<double>")


def _matrix(rows: DataFrame) -> np.ndarray:
    return np.array([r["x"] for r in rows.select("x").collect()], dtype=float).reshape(-1, N_FEATURES)


def fit(rows: DataFrame, labels: DataFrame, label_col: str = "quality",
        held_out: str = "pmod(crc32(cast(doc_id as string)), 5) = 0", positives: int = POSITIVES) -> Model | None:
    """Learns from at most ``positives`` trusted rows of :func:`described` documents, by seeded hash, and all others.

    Rows for which ``held_out`` is true, and null ids, are not learnt from. Positives are ids with label 1
    (and no other label); the unlabelled are all rows, whatever their label. None without positives.
    """
    open_ = F.expr(f"doc_id IS NOT NULL AND NOT coalesce({held_out}, false)")
    trusted = labels.filter(open_).filter(F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.min(label_col).alias("y"))
    chosen = ordered_ids(trusted.filter("y = 1"), positives, SEED)
    first = rows.join(F.broadcast(chosen), "doc_id").groupBy("key", "doc_id").agg(F.min("x").alias("x"))  # rows that repeat an id: one
    p = _matrix(first.orderBy("key", "doc_id"))
    return learn(p, rows.filter(open_)) if len(p) else None


def score(rows: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, score`` of described rows; without a model every score is 0.5."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
            s = np.full(len(x), 0.5) if model is None else model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double")


def quality(docs: DataFrame, labels: DataFrame, held_out: str = "pmod(crc32(cast(doc_id as string)), 5) = 0",
            label_col: str = "quality") -> DataFrame:
    """One row per document: ``doc_id, score``, higher where a positive label is likelier.

    Null and empty texts, and texts without words, are all zeros and get that vector's score. Repeated rows
    and null ids are kept; an empty table gives an empty result; other columns play no part.
    """
    rows = stage(described(docs), "features")
    return score(rows, fit(rows, labels, label_col, held_out))
