from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from odd_rows import ODD

from seatwise.llm import toxic_crf as T


def slow_marginals(emission, first, start, chain):
    """Sum over all paths of each text."""
    out, bounds = np.zeros(len(emission)), [*first.tolist(), len(emission)]
    for a, b in zip(bounds, bounds[1:]):
        n, total, ones = b - a, 0.0, np.zeros(b - a)
        for path in range(1 << n):
            s = [path >> k & 1 for k in range(n)]
            w = start * s[0] + sum(emission[a + k] * s[k] for k in range(n)) + sum(chain[s[k], s[k + 1]] for k in range(n - 1))
            total += np.exp(w)
            ones += np.exp(w) * np.array(s)
        out[a:b] = ones / total
    return out


@pytest.mark.parametrize("seed", range(5))
def test_marginals_against_all_paths(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 9, 12)
    first = np.cumsum(lengths) - lengths
    e, chain = rng.normal(0, 2, lengths.sum()), rng.normal(0, 1, (2, 2))
    p, pairs = T.marginals(e, first, -0.5, chain)
    assert np.allclose(p, slow_marginals(e, first, -0.5, chain))
    assert abs(pairs.sum() - (lengths - 1).sum()) < 1e-6


def corpus():
    rng = random.Random(2)
    plain = [f"{a}{b}{c}" for a in "bcdfgl" for b in "aeiou" for c in ("n", "rt", "mas", "lin")]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randint(1, 60))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(["Grotz,", "zwek" + rng.choice(plain)]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_documents_and_offsets(spark, docs):
    rows, labels = corpus()
    labels = spark.createDataFrame([*labels, (None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    df = docs([*rows, *ODD])
    model = T.fit(df, labels)
    out = T.tag(df, model).collect()
    assert len(out) == len(rows) + len(ODD) and all(0 <= r.score <= 1 for r in out)
    text = dict(rows)
    right = 0
    for r in out:
        if r.doc_id in text and r.doc_id > 7:
            right += (r.score >= 0.7) == (r.doc_id % 3 == 0)
            assert {text[r.doc_id][s["start"]:s["end"]].lower()[:4] for s in r.spans} <= {"grot", "zwek"}
    assert right >= 0.97 * (len(rows) - 8)
    kept = T.without_toxic(df, model, 0.7)
    assert kept.columns == df.columns and kept.count() == sum(r.score < 0.7 for r in out)


def test_without_labels_and_empty_tables(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = T.fit(docs(ODD), none)
    assert all(r.score < 1e-9 and not r.spans for r in T.tag(docs(ODD), model).collect())
    assert T.tag(docs([]), model).collect() == []


def test_long_labelled_texts_do_not_empty_the_sample(spark, docs):
    rows, labels = corpus()
    first = sorted((i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 3 != 1),
                   key=lambda i: hashlib.md5(f"{T.SEED}:{i}".encode()).hexdigest())[:2]
    long = [(first[0], "ban " * 25_000, 0), (first[1], "Grotz, ban " * 9_000, 1)]
    labels = spark.createDataFrame([*labels, *[(i, 1, y) for i, _, y in long]], "doc_id long, quality int, toxic int")
    model = T.fit(docs([*rows, *[r[:2] for r in long]]), labels, sample_chars=40_000)
    out = T.tag(docs(rows), model).collect()
    assert sum((r.score >= 0.7) == (r.doc_id % 3 == 0) for r in out) >= 0.97 * len(rows)


def test_a_label_without_a_sample_is_an_error(spark, docs):
    rows, labels = corpus()
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    with pytest.raises(ValueError, match="fits"):
        T.fit(docs(rows), labels, sample_chars=0)


def test_cues_are_counted_in_all_labelled_rows(spark, docs):
    """Eight cues, too rare in a sample of 40 to be tied to anything."""
    rng, (rows, _) = random.Random(3), corpus()
    rows = [(i, t.replace("Grotz,", "ban").replace("zwek", "ban") + (f" {rng.choice('bdfgklmn')}{'uq' * 3}" if i % 3 == 0 else "")) for i, t in rows]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    out = T.tag(docs(rows), T.fit(docs(rows), labels, sample_rows=40)).collect()
    assert sum((r.score >= 0.7) == (r.doc_id % 3 == 0) for r in out) >= 0.97 * len(rows)


def test_counts_of_cues_against_a_loop(spark, monkeypatch):
    rows = [(i % 2, t) for i, (_, t) in enumerate(corpus()[0][:200])]
    want = Counter((c, y) for y, t in rows for c in {c for w in t.encode().split() for c in T.cues(w)})
    got = {r.cue: (r.clean, r.toxic) for r in T.frequencies(spark.createDataFrame(rows, "y int, text string").repartition(5)).collect()}
    assert got == {c: (want[c, 0], want[c, 1]) for c, _ in want}


def test_ties_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(f"c{k}", rng.choice([0, 1, 3, 200]), rng.choice([0, 1, 5, 8, 30, 60])) for k in range(300)]
    n_toxic, n_clean = 100, 900
    tied = T.tied_cues(spark.createDataFrame(rows, "cue string, clean long, toxic long"), n_toxic, n_clean)
    want = set()
    for cue, clean, toxic in rows:
        ratio = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
        g = 2 * sum(x * np.log(x / ((clean + toxic) * share)) for x, share in ((toxic, 0.1), (clean, 0.9)) if x)
        if ratio > T.LOG_RATIO and g > 2 * np.log(len(rows) + 1) + T.G_MORE:
            want.add(cue)
    assert set(tied) == want and 10 < len(want) < 200 and sorted(tied.values()) == list(range(len(want)))


TIED = {"wgrotz": 0, "pzwe": 1, "pzwek": 2}


def a_chunk(seed):
    rng = random.Random(seed)
    texts = [(rng.randint(0, 1), " ".join(rng.choice(["ban", "lin", "Grotz,", "zweka", "zwen", ""]) for _ in range(rng.randint(0, 9))).encode())
             for _ in range(12)]
    return dict(zip([c.split()[0] for c in T.CHUNK.split(", ")], T._chunk(texts, TIED))), texts


def loss(texts, point):
    """Negative log-likelihood, by the sum over all paths of each text."""
    total, chain = 0.0, point[-4:].reshape(2, 2)
    for y, text in texts:
        words = text.split()
        own = [T.numbers(w, TIED) for w in words]
        e = [point[-6] + sum(point[k] for k in ks) for ks in own]
        score = lambda s: (point[-5] * s[0] + sum(x for x, b in zip(e, s) if b)
                           + sum(chain[a, b] for a, b in zip(s, s[1:]))) if s else 0.0
        paths = [[k >> i & 1 for i in range(len(words))] for k in range(1 << len(words))]
        total += np.log(sum(np.exp(score(s)) for s in paths)) - score([int(bool(y and ks)) for ks in own])
    return total


@pytest.mark.parametrize("seed", range(3))
def test_gradient_against_finite_differences(seed):
    row, texts = a_chunk(seed)
    point = np.random.default_rng(seed).normal(0, 1, len(TIED) + T.REST)
    got = T.Sample([row]).gradient(point)
    for k in range(len(point)):
        step = np.zeros(len(point))
        step[k] = 1e-5
        assert abs((loss(texts, point + step) - loss(texts, point - step)) / 2e-5 - got[k]) < 1e-5


@pytest.mark.parametrize("seed", range(4))
def test_runs_in_one_step_against_all_tokens(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.choice([1, 2, 3, 30, 400], 40)
    first = np.cumsum(lengths) - lengths
    ids = rng.choice([0, 0, 0, 0, 0, 0, 1, 2], lengths.sum()).astype(np.int32)
    ids[first[5]:first[5] + lengths[5]] = 0
    e, chain = rng.normal(0, 2, 4), rng.normal(0, 1, (2, 2))
    p, pairs = T.marginals(e[ids], first, -0.5, chain)
    expected, opening, steps = T.Texts(ids, first).expectations(e, -0.5, chain)
    assert np.allclose(expected, np.bincount(ids, weights=p, minlength=4))
    assert np.allclose(opening, p[first].sum()) and np.allclose(steps.ravel(), pairs)


def test_chunks_add_up_and_summaries_are_of_marginals(monkeypatch):
    monkeypatch.setattr(T, "TOKENS_AT_ONCE", 7)
    rows = [a_chunk(seed)[0] for seed in range(4)]
    point = np.random.default_rng(1).normal(0, 1, len(TIED) + T.REST)
    whole = T.Sample(rows)
    assert np.allclose(whole.gradient(point), sum(T.Sample([r]).gradient(point) for r in rows))
    p, _ = T.marginals(whole.emission(point)[whole.ids], whole.first, point[-5], point[-4:].reshape(2, 2))
    want = [T._summary(q) for q in np.split(p, np.cumsum(whole.lengths)[:-1])]
    assert np.allclose(whole.summaries(point), want)


def test_descent_reaches_the_least_point():
    rng = np.random.default_rng(0)
    a = rng.normal(0, 1, (30, 30))
    a, b = a @ a.T + 0.1 * np.eye(30), rng.normal(0, 1, 30)
    x = T.descend(lambda x: a @ x + np.exp(x) - b, np.zeros(30), steps=400, enough=1e-9)
    assert np.abs(a @ x + np.exp(x) - b).max() < 1e-7


def a_model():
    chain = np.log(np.array([[0.9, 0.1], [0.6, 0.4]]))
    return T.Model(TIED, np.array([4.0, 1.0, 2.0]), -1.5, -0.7, chain, np.array([1.0, 1.0, -2.0]))


def swept(model, words):
    e = [x if (x := model.emission(w)) is not None else model.bias for w in words]
    return T.marginals(np.array(e), np.array([0]), model.start, model.chain)[0]


@pytest.mark.parametrize("n", [1, 2, 3, 50, 700])
def test_texts_without_cues_are_looked_up(n):
    model = a_model()
    words = [b"ban"] * n
    assert np.allclose(T.plain_marginals(model, n), swept(model, words), atol=1e-12)
    both = T._token_marginals(model, [b"ban " * n, b"ban Grotz, ban zweka", b"", b" Grotz, "])
    assert np.allclose(both[0], swept(model, words)) and np.allclose(both[1], swept(model, b"ban Grotz, ban zweka".split()))
    assert len(both[2]) == 0 and np.allclose(both[3], swept(model, [b"Grotz,"]))


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(T, "LONG", 40)
    rng, model = random.Random(2), a_model()
    for _ in range(20):
        text = "".join(rng.choice(["ban ", "Grotz, ", "zweka\n", " " * 50, "x" * 90]) for _ in range(rng.randint(1, 40))).encode()
        assert b"".join(T._pieces(text)) == text
        assert np.allclose(T.long_marginals(model, text), swept(model, text.split()) if text.split() else [], atol=1e-10)


def test_a_rare_labelled_id_of_another_type(spark, docs):
    rows, labels = corpus()
    labels = spark.createDataFrame([(i, q, t) for i, q, t in labels], "doc_id int, quality int, toxic int")
    out = T.tag(docs(rows), T.fit(docs(rows), labels)).collect()
    assert sum((r.score >= 0.7) == (r.doc_id % 3 == 0) for r in out) >= 0.97 * len(rows)
