from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from odd_rows import ODD
from hypothesis import given, settings
from hypothesis import strategies as st

from seatwise.llm import packing as P

TEXTS = ["", " ", "a  b", " a", "a ", "a \n b", "\n", "it's  'll <|endoftext|> b<|endoftext|>", "　 z   q", "a\x1c b\x1c \x1cc",
         "\x85 q \x85", "é ü 日本 語", "a\n\nb c\n d\ne f\r\ng h\t\ni", "don't. can'! x'. y.'s z.\n's", " ab!\n!c d.e.f. 5. ab5%%% 日.本. ﬁ. ̀. ª. Ⅷ."]


def check_plan(counts, capacity=2048):
    ranks, bins = defaultdict(list), defaultdict(list)
    for length, a, b, first, offset in P.plan(counts, capacity).tolist():
        ranks[length].append((a, b))
        for r in range(a, b):
            bins[first + r - a].append((offset, length))
    for length, n in counts.items():
        at = 0
        for a, b in sorted(ranks[length]):
            assert a == at
            at = b
        assert at == n
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plans_place_every_piece_once(counts):
    assert check_plan(counts, 64) >= -(-sum(k * n for k, n in counts.items()) // 64)


def test_plan_is_close_to_the_bound():
    x = np.clip(np.random.default_rng(0).lognormal(6.2, 0.9, 20_000).astype(int), 1, 2048)
    length, n = np.unique(x, return_counts=True)
    assert check_plan(dict(zip(length.tolist(), n.tolist()))) <= 1.02 * x.sum() / 2048


def direct(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.default_tokenizer())
    return [np.array(t.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in texts]


def test_ids_are_those_of_the_tokenizer():
    assert P.Encoder(P.default_tokenizer())(TEXTS) == direct(TEXTS)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert P.encoder(P.default_tokenizer())([text]) == direct([text])


@pytest.mark.parametrize("blank", [" ", "\n", "\u3000"])
def test_ids_of_long_runs_of_white_space(blank):
    texts = ["x" + blank * n + "y" for n in (P.SAFE_RUN, P.SAFE_RUN + 1, 2_000_000)]
    assert P.encoder(P.default_tokenizer())(texts) == direct(texts)


def test_other_tokenizers_go_through_the_library():
    import public_tokenizers
    assert P.Encoder(public_tokenizers.path("word_bpe_49k.json")).ranked is None


def test_pack(docs):
    got = P.pack(docs(ODD)).collect()
    ids = [d + b"\0\0\0\0" for d in direct([t or "" for _, t in ODD])]
    assert sum(r.length for r in got) == sum(len(d) // 4 for d in ids)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        pieces[r.doc_id].append((r.start, r.piece, bytes(r.ids)))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, own in pieces.items():
        want = [d for (j, _), d in zip(ODD, ids) if j == i]
        if len(want) == 1:
            assert b"".join(x for _, _, x in sorted(own)) == want[0]
            assert [p for _, p, _ in sorted(own)] == list(range(len(own)))
    for items in sequences.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    assert P.pack(docs([])).collect() == []


@pytest.mark.parametrize("n", [1, 2047, 2048, 2049, 4096, 5000])
def test_only_the_first_piece_may_be_short(n):
    cut = P.cut(n)
    assert sum(k for _, k in cut) == n and all(k == 2048 for _, k in cut[1:]) and cut[0][1] <= 2048
