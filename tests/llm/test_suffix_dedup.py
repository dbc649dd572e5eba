from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from odd_rows import ODD

from seatwise.llm import suffix_dedup as S


def slow(texts, length):
    """(n_bytes, spans, kept) of each text, from all its strings."""
    counts = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if counts[t[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        edges = [i for i in range(len(t) + 1) if (gone + [False])[i] != ([False] + gone)[i]]
        out.append((len(t), list(zip(edges[::2], edges[1::2])), bytes(c for c, g in zip(t, gone) if not g)))
    return out


@pytest.mark.parametrize("length", [1, 3, 8, 9, 20, 33])
def test_ranks_against_all_strings(length):
    rng = random.Random(length)
    for _ in range(60):
        base = bytes(rng.choice(b"ab") for _ in range(60))
        texts = []
        for _ in range(rng.randint(0, 6)):
            a = rng.randrange(60)
            texts.append(bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 15))) + base[a:rng.randint(a, 60)] + b"c" * rng.randint(0, 9))
        counts = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
        want = [i + length <= len(t) and counts[t[i:i + length]] > 1 for t in texts for i in range(len(t))]
        assert S.repeated_strings(texts, length).tolist() == want


def test_each_string_has_one_anchor_wherever_it_stands():
    rng = random.Random(1)
    same = bytes(rng.choice(b"ab ") for _ in range(40))
    for _ in range(40):
        own = [bytes(rng.choice(b"ab ") for _ in range(rng.randint(0, 30))) for _ in range(2)]
        found = []
        for data, start in ((own[0] + same + own[1], len(own[0])), (own[1] + same, len(own[1]))):
            text, first, number, gram = S.anchors(data, np.array([len(data)]), 32)
            assert sum(number) == len(data) - 31 and not text.any()
            found.append([next(g for f, n, g in zip(first, number, gram) if f <= s < f + n) for s in range(start, start + 9)])
        assert found[0] == found[1]


def corpus(rng, length):
    words = [bytes(rng.choice(b"abcdefgh") for _ in range(rng.randint(1, 6))).decode() for _ in range(50)] + ["é", "日本"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    common, rows = text(2 * length // 4), []
    for i in range(160):
        kind, t = i % 8, text(rng.randint(0, length))
        if kind == 0:
            t = text(9) + common + text(rng.randint(0, 9))  # more than LARGE contexts at its ends
        elif kind == 1 and rows:
            old = rng.choice(rows)[1] or ""
            at = rng.randrange(len(old) + 1)
            t = old[:at] + "#" + old[at:]
        elif kind == 2 and rows:
            t = rng.choice(rows)[1]
        elif kind == 3:
            t = text(3) * length
        rows.append((rng.choice([i, i, i, 7, None]), t))
    return rows + rows[:5]


@pytest.mark.parametrize("seed,length,large", [(1, 40, 8), (2, 25, 4), (3, 64, 1000)])
def test_against_all_strings(spark, docs, monkeypatch, seed, length, large):
    monkeypatch.setattr(S, "LARGE", large)
    rows = corpus(random.Random(seed), length) + [r for r in ODD if len(r[1] or "") < 1000]
    out = S.remove_repeats(docs(rows), length).collect()
    got = [(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in out]
    want = [(r[0], *x) for r, x in zip(rows, slow([(r[1] or "").encode() for r in rows], length))]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert 0 < sum(len(r[3]) for r in got) < sum(r[1] for r in got)


def test_long_texts_in_pieces(spark, docs):
    """A passage that stands where the pieces of a long text meet."""
    rng, edge = random.Random(5), 1 << S.AT_ONCE_BITS
    text = "".join(rng.choices("abcdefgh ", k=2 * edge))
    rows = [(1, text), (2, "X" + text[edge - 900:edge + 700] + "Y"), (3, "z" * 700)]
    out = {r.doc_id: r for r in S.remove_repeats(docs(rows)).collect()}
    assert [tuple(s) for s in out[1].spans] == [(edge - 900, edge + 700)]
    assert bytes(out[2].kept) == b"XY" and bytes(out[3].kept) == b""


def test_odd_rows_and_empty_table(spark, docs):
    out = S.remove_repeats(docs(ODD), digest=True).collect()
    assert len(out) == len(ODD) and sum(len(r.spans) for r in out) == 1  # the long text repeats itself
    assert S.remove_repeats(docs([])).collect() == []
