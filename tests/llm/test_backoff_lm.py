from __future__ import annotations

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from odd_rows import ODD

from seatwise.llm import backoff_lm as B


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def brute(rows, order, m):
    """Score of every row under weight m, straight from dictionaries of n-grams."""
    own = [(i, B.tokens(t)) for i, t in rows]
    count = [Counter() for _ in range(order)]
    for i, w in own:
        if not held(i):
            p = [B.END] * (order - 1) + w
            for k in range(order):
                count[k].update(tuple(p[n - k:n + 1]) for n in range(order - 1, len(p)))
    n, v = sum(count[0].values()), len(count[0])
    n1, n2 = (sum(c == x for c in count[0].values()) for x in (1, 2))
    d = n1 / (n1 + 2 * n2 + 1)
    out = []
    for i, w in own:
        p, total = [B.END] * (order - 1) + w, 0.0
        for at in range(order - 1, len(p)):
            c = count[0][(p[at],)]
            q = (max(c - d, 1e-9) if c else max(d * v, 1.0)) / n if n else 1.0
            for k in range(1, order):
                context = count[k - 1][tuple(p[at - k:at])]
                if context and k <= at - order + 2:  # words read so far, and the end before them
                    q = (count[k][tuple(p[at - k:at + 1])] + m * q) / (context + m)
            total += math.log10(q)
        base = sum(math.log10((count[0][(x,)] + 1) / (n + v + 1)) for x in w)
        out.append((i, held(i), len(w), sum(count[0][(x,)] > 0 for x in w), n, base, total))
    return out


def texts(n):
    rng = random.Random(4)
    words = [f"W{k}" for k in range(30)]
    return [(i, " ".join(rng.choice(words[: 3 + i % 28]) for _ in range(rng.randint(0, 40)))) for i in range(n)]


def left_out(rows, order, m):
    """Likelihood of the training tokens, each left out of the counts in turn."""
    own = [[B.END] * (order - 1) + B.tokens(t) for i, t in rows if not held(i)]
    count = [Counter() for _ in range(order)]
    for p in own:
        for k in range(order):
            count[k].update(tuple(p[n - k:n + 1]) for n in range(order - 1, len(p)))
    n, v = sum(count[0].values()), len(count[0])
    n1, n2 = (sum(c == x for c in count[0].values()) for x in (1, 2))
    d, total = n1 / (n1 + 2 * n2 + 1), 0.0
    for p in own:
        for at in range(order - 1, len(p)):
            c = count[0][(p[at],)] - 1
            q = (max(c - d, 1e-9) if c else max(d * v, 1.0)) / n
            for k in range(1, order):
                left = count[k - 1][tuple(p[at - k:at])] - 1
                if left > 0 and k <= at - order + 2:
                    q = (count[k][tuple(p[at - k:at + 1])] - 1 + m * q) / (left + m)
            total += math.log10(q)
    return total


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_against_dictionaries(docs, order):
    """Under the weight that the dictionaries choose."""
    rows = [*ODD[:7], *ODD[8:], *texts(120)]
    got = B.score(docs(rows), order=order, block_tokens=300, shard_tokens=200).collect()
    best = max(B.WEIGHTS, key=lambda m: (round(left_out(rows, order, m), 6), -m))
    want = brute(rows, order, best)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == \
        sorted((str(i), h, n, k, t, round(base, 6), round(s, 6)) for i, h, n, k, t, base, s in want)


def test_the_automaton_carries_its_state():
    """Reading a word follows the longest seen n-gram; the state then is the longest seen context."""
    rows = [(i, t) for i, t in texts(60)]
    words = [B.tokens(t) for _, t in rows]
    number = B._Numbers({B.END: 0})
    ids = [[number[w] for w in x] for x in words]
    b = B._Block(np.array([len(x) for x in ids]), np.array([held(i) for i, _ in rows]),
                 B._squeeze(np.concatenate([np.array(x, dtype=np.uint32) for x in ids])),
                 zstandard.ZstdCompressor().compress(b" ".join(list(number)[1:])))
    count = [Counter() for _ in range(3)]
    for x, (i, _) in zip(words, rows):
        p = [B.END] * 2 + x
        if not held(i):
            for k in range(3):
                count[k].update(tuple(p[n - k:n + 1]) for n in range(2, len(p)))
    totals = [np.array([count[0][(b.words[i],)] for i in b.order])]
    padded = [[B.END] * 2 + x for x in words]
    for k in (2, 3):
        _, at = np.unique(b.numbers(k), return_index=True)
        grams = [tuple(p[n - k + 1:n + 1]) for p in padded for n in range(2, len(p))]
        totals.append(np.array([count[k - 1][grams[t]] for t in at]))
    a = B.Automaton(b, totals, 3)
    states, fails, arcs = a.read(b)
    at = 0
    for p in padded:
        for n in range(2, len(p)):
            context = max((k for k in (0, 1, 2) if not k or (k == 1 or n > 2) and count[k - 1][tuple(p[n - k:n])]))
            taken = max((k for k in range(context + 1) if not k or count[k][tuple(p[n - k:n + 1])]))
            assert fails[at] == context - taken
            assert (1 if arcs[at] < a.words else a.length[arcs[at] - a.words]) == taken + 1
            assert a.size[states[at]] == (count[context - 1][tuple(p[n - context:n])] if context else 0)
            at += 1


def test_a_block_is_read_in_bounded_memory():
    rng = np.random.default_rng(5)
    lengths = np.full(400, 500)
    ids = (20_000 * rng.random(lengths.sum()) ** 3).astype(np.uint32)
    ids[499::500] = 0
    words = zstandard.ZstdCompressor().compress(b" ".join(b"w%d" % i for i in range(1, 20_000)))
    b = B._Block(lengths, np.zeros(400, dtype=bool), B._squeeze(ids), words)
    totals = [np.bincount(b.ids, minlength=len(b.words))[b.order], *[np.unique(b.numbers(k), return_counts=True)[1] for k in (2, 3)]]
    tracemalloc.start()
    a = B.Automaton(b, totals, 3)
    a.read(b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160 * len(b.ids)  # bytes a token


def test_nothing_to_learn_from_and_empty_table(docs):
    i = next(i for i in range(100) if held(i))
    r, = B.score(docs([(i, "a b")])).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score) == (3, 0, 0, 0.0)
    assert B.score(docs([])).collect() == []
