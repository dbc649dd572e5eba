from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from odd_rows import ODD

from seatwise.llm import periodic as P


def slow_runs(words, least=6, times=4):
    n, out = len(words), set()
    for a in range(n):
        for b in range(a + least, n + 1):
            s = words[a:b]
            q = next(q for q in range(1, len(s) + 1) if all(s[i] == s[i + q] for i in range(len(s) - q)))
            if (len(s) >= max(least, times * q) and not (a > 0 and words[a - 1] == words[a - 1 + q])
                    and not (b < n and words[b] == words[b - q])):
                out.add((a, b - a, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def sample(rng, most=45):
    n, letters = rng.randint(0, most), rng.choice([1, 2, 2, 3, 5])
    w = [b"%d" % rng.randrange(letters) for _ in range(n)]
    if n and rng.random() < 0.6:
        a, p = rng.randrange(n), rng.randint(1, 5)
        w = w[:a] + [w[a + k % p] if a + k % p < n else b"x" for k in range(n - a)]
    return w


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_all_stretches(seed):
    rng = random.Random(seed)
    for _ in range(120):
        w = sample(rng)
        assert P.runs(w) == slow_runs(w)


def test_long_periods_and_long_texts():
    rng = random.Random(9)
    base = [b"%d" % rng.randrange(10**6) for _ in range(700)]
    w = [b"a", b"b"] + base * 5 + base[:100] + [b"c"]
    assert P.runs(w) == [(2, 3600, 700)]
    assert P.runs([b"w"] * 300_000) == [(0, 300_000, 1)]
    assert P.runs([b"w", b"v"] * 100_000 + [b"w"] * 7) == [(0, 200_001, 2), (200_000, 7, 1)]


def test_rare_words_split_until_stable():
    import numpy as np
    # 9 is rare at once; with it gone 1 is rare in the left piece; nothing frequent is left there
    ids = np.array([1, 2, 2, 2, 1, 2, 9, 1, 1, 3, 3, 3, 3, 3, 3])
    assert P.frequent_segments(ids) == [(9, 15)]


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = slow_runs(words)
    gone = {i for a, b, q in found for i in range(a + q, a + b)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (doc_id, len(found), *(best or (None,) * 3), best and best[1] * 1000 // best[2],
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def key(row):
    return tuple((x is None, x) for x in row)


def test_digests_against_brute_force(spark, docs):
    rng = random.Random(4)
    rows = [(i, " ".join(w.decode() + rng.choice(["", "é"]) for w in sample(rng, 40))) for i in range(150)]
    rows += [r for r in ODD if len(r[1] or "") < 1000] + [(None, "a a a a a a a"), (10**12, "b " * 9), (10**12, "b " * 9)]
    out = P.digests(docs(rows), plant=True).collect()
    assert sorted(map(tuple, out), key=key) == sorted((expected(*r) for r in rows), key=key)
    assert sum(r.n_runs > 0 for r in out) > 20


def test_kept_text_and_offsets(spark, docs):
    out = {r.doc_id: r for r in P.collapse(docs([(1, "x a b a b a b a b a\ny"), *ODD[4:6], ODD[7]])).collect()}
    assert [tuple(r) for r in out[1].runs] == [(1, 9, 2)] and out[1].text == "x a b y"
    assert out[5].runs == [] and out[5].text == "" and out[4].text == ""
    assert [tuple(r) for r in out[6].runs] == [(0, 60_000, 1)] and out[6].text == "word"
    assert P.digests(docs([])).collect() == [] and P.collapse(docs([])).collect() == []
