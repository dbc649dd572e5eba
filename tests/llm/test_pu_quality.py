from __future__ import annotations

import random

import numpy as np
from odd_rows import ODD

from seatwise.llm import pu_quality as Q


def prior(p, u):
    at = np.unique(p)
    mass = lambda x: np.array([(x >= t).mean() for t in at])
    return Q.class_prior(at, mass(p), mass(u), len(p), len(u))


def test_prior_of_a_mixture():
    rng = np.random.default_rng(0)
    p = rng.normal(2, 1, 2000)
    for share in (0.2, 0.5, 0.8):
        n = int(share * 4000)
        u = np.concatenate([rng.normal(2, 1, n), rng.normal(-2, 1, 4000 - n)])
        assert abs(prior(p, u) - share) < 0.08


def described(spark, n, parts, seed=0):
    x = np.random.default_rng(seed).normal(0, 1, (n, Q.N_FEATURES)) ** 3
    x[:, 5] = 0.25
    return x, spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id long, x array<double>").repartition(parts)


def test_sums_cover_all_rows(spark):
    x, rows = described(spark, 700, 6)
    centre, scale, n = Q.spread(rows)
    assert n == 700 and np.allclose(centre, x.mean(axis=0)) and np.allclose(scale[:5], x.std(axis=0)[:5]) and scale[5] == 1
    at = np.sort(x[:40, 0])
    assert np.allclose(Q.masses(rows, at, lambda y: y[:, 0]), [(x[:, 0] >= t).sum() for t in at])


def test_least_risk_against_plain_descent(spark):
    """The fit over a table equals plain gradient descent on the risk of the same rows in memory."""
    x, rows = described(spark, 300, 4, seed=2)
    positive = x[:90] + 0.4
    model = Q.learn(positive, rows)
    p, u = (Q.expanded((y - model.centre) / model.scale) for y in (positive, x))

    def risk(w):
        at_p, at_u = p @ w, u @ w
        negative = np.logaddexp(0, at_u).mean() - model.prior * np.logaddexp(0, at_p).mean()
        return model.prior * np.logaddexp(0, -at_p).mean() + max(0, negative) + 0.5 * Q.PENALTY * w @ w

    w = np.zeros(p.shape[1])
    for t in range(6000):
        at_p, at_u = p @ w, u @ w
        g = model.prior * (p.T @ (Q.sigmoid(at_p) - 1)) / len(p) + Q.PENALTY * w
        if np.logaddexp(0, at_u).mean() >= model.prior * np.logaddexp(0, at_p).mean():
            g = g + u.T @ Q.sigmoid(at_u) / len(u) - model.prior * (p.T @ Q.sigmoid(at_p)) / len(p)
        w -= 0.05 * g
    assert risk(model.weights) <= risk(w) + 0.01 < risk(np.zeros(len(w)))


def corpus():
    rng = random.Random(1)
    plain = [f"{a}{b}{c}" for a in "bcdfgl" for b in "aeiou" for c in ("n", "rt", "mas", "lin")]
    rows, labels = [], []
    for i in range(800):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        good = i % 4 > 0
        text = " ".join(words) + "." if good else rng.choice([" | ".join(words), "!! ".join(words).upper(), " ".join(words[:1] * 40)])
        rows.append((i, text))
        if i % 2 or i % 8 == 0:
            labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_documents(spark, docs):
    rows, labels = corpus()
    labels = spark.createDataFrame([*labels, (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    got = Q.quality(docs([*rows, *ODD]), labels).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 for r in got)
    right = [(r.score >= 0.3) == (r.doc_id % 4 > 0) for r in got if r.doc_id is not None and r.doc_id > 7]
    assert np.mean(right) > 0.97


def test_features_are_finite():
    for t in ("", " \n", "a", "|", "é" * 1000, "x\n\ny", "\0 \x1f"):
        x = Q.features(t.encode())
        assert len(x) == Q.N_FEATURES and np.isfinite(x).all()


def test_without_labels_and_empty_tables(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in Q.quality(docs(ODD), none).collect()} == {0.5}
    assert Q.quality(docs([]), none).collect() == []
