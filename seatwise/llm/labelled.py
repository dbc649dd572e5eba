"""Bounded, seeded samples of labelled documents, and hashed word features, for the trained operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1 << 20


def ordered_ids(ids: DataFrame, rows: int, seed: str) -> DataFrame:
    """At most ``rows`` ids, those of the smallest seeded hash."""
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    return ids.select("doc_id", key.alias("key")).orderBy("key", "doc_id").limit(rows).select("doc_id", "key")


def fitting(docs: DataFrame, ids: DataFrame, chars: int) -> DataFrame:
    """``key, doc_id, text`` of the sampled ids: in hash order, each whole text that still fits into ``chars`` characters.

    A text that doesn't fit is passed over and counts against none of the later ones; rows that repeat id
    and text count once. Raises if there are texts and none fits.
    """
    own = (docs.join(F.broadcast(ids), "doc_id")  # as many ids as the sample has at most
           .select("key", "doc_id", "text", F.xxhash64("text").alias("hash")))
    sizes = own.select("key", "doc_id", "hash", F.length("text").alias("size")).distinct()  # about as many as there are ids
    sizes = sizes.repartition(1).sortWithinPartitions("key", "doc_id", "hash")
    fits, left, seen = [], chars, 0
    for r in sizes.toLocalIterator():
        seen += 1
        if max(1, r["size"]) <= left:
            left -= max(1, r["size"])
            fits.append((r["doc_id"], r["hash"]))
            if not left:
                break
    if seen and not fits:
        raise ValueError(f"none of {seen} labelled texts fits into the sample's {chars} characters")
    chosen = docs.sparkSession.createDataFrame(fits, own.select("doc_id", "hash").schema)
    return own.dropDuplicates(["doc_id", "hash"]).join(F.broadcast(chosen), ["doc_id", "hash"]).select("key", "doc_id", "text")


def bucket(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature.encode("utf-8", "surrogatepass"), 7) % DIMENSIONS


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights (the last is the constant) of a penalised logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([*[penalty] * (x.shape[1] - 1), 1e-9]) * weight.sum()
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (weight * (p - y)) + ridge @ w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def descend(gradient: Callable[[np.ndarray], np.ndarray], point: np.ndarray, steps: int = 60, enough: float = 1e-3,
            memory: int = 8, stride: float = 1.0) -> np.ndarray:
    """The least point of a convex function, from its gradient, by a quasi-Newton method with limited memory.

    Ends after ``steps`` gradients, or when the gradient is ``enough`` times the first one. No coordinate
    moves by more than ``stride`` at once; a step that goes past the least point on its line, or to where the
    gradient is no number, is cut back. Returns the point with the least gradient that was met.
    """
    g = gradient(point)
    size = np.linalg.norm(g)
    aim, pairs, best = enough * size, [], (size, point)
    used = 1
    while used < steps and size > aim:
        d, kept = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ d) / (s @ y)
            d -= a * y
            kept.append(a)
        d *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / size
        for (s, y), a in zip(pairs, reversed(kept)):
            d += (a - (y @ d) / (s @ y)) * s
        d = -d
        if g @ d >= 0:  # the remembered curvature is of no use here
            d, pairs = -g / size, []
        share = min(1.0, stride / max(float(np.abs(d).max()), 1e-300))
        slope, new = g @ d, None
        while used < steps:
            new = gradient(point + share * d)
            used += 1
            if np.isfinite(new).all() and new @ d <= -0.5 * slope:
                break
            share *= min(0.5, max(0.1, slope / (slope - new @ d))) if np.isfinite(new).all() else 0.1
            new = None
        if new is None:
            break
        s, y = share * d, new - g
        if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
            pairs = [*pairs[1 - memory:], (s, y)]
        point, g, size = point + s, new, np.linalg.norm(new)
        if size < best[0]:
            best = (size, point)
    return best[1]
