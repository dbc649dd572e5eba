from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from odd_rows import ODD
from pyspark.sql import functions as F

from seatwise.llm import simhash as S


def slow(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(points, bits=3):
    parent = {p: p for p in points}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ps = list(points)
    for i, a in enumerate(ps):
        for b in ps[i + 1:]:
            if bin(a ^ b).count("1") <= bits:
                parent[find(b)] = find(a)
    return {p: find(p) for p in ps}


def test_fingerprints_and_components(docs):
    rng = random.Random(1)
    rows = list(ODD) + [(100 + i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))) for i in range(150)]
    base = " ".join(f"w{i}" for i in range(400))
    rows += [(300 + i, base.replace(f"w{i} ", "x ", 1)) for i in range(20)]
    got = S.near_dedup(docs(rows)).select("doc_id", S.hex_digits(F.col("fp")).alias("h"), "component_id").collect()
    fp = [slow(t) for _, t in rows]
    of = groups(set(fp))
    least = {}
    for (i, _), f in zip(rows, fp):
        if i is not None:
            least[of[f]] = min(i, least.get(of[f], i))
    want = sorted([(i, f"{f:016x}", least.get(of[f])) for (i, _), f in zip(rows, fp)], key=str)
    assert sorted([tuple(r) for r in got], key=str) == want


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 4, 5])
def test_links_are_exactly_the_near_pairs(spark, bits):
    rng = np.random.default_rng(bits)
    own = {int(x) for x in rng.integers(0, 1 << 63, 40)} | {0, (1 << 64) - 1}
    for x in list(own):
        for _ in range(4):
            y = x
            for b in rng.integers(0, 64, rng.integers(1, 8)):
                y ^= 1 << int(b)
            own.add(y)
    own = sorted(own)
    df = spark.createDataFrame([(n, int(np.uint64(x).astype(np.int64))) for n, x in enumerate(own)], "node long, fp long")
    got = {tuple(sorted(r)) for r in S.links(df, bits).collect()}
    assert got == {(i, j) for i in range(len(own)) for j in range(i + 1, len(own)) if bin(own[i] ^ own[j]).count("1") <= bits}


def test_one_row_of_each_group_stays(docs):
    df = docs(ODD)
    out = S.keep_first(df)
    assert out.columns == df.columns
    assert S.keep_first(docs([])).collect() == []
    rows = S.near_dedup(df).collect()
    assert out.count() == sum(r.row == r.first_row for r in rows) == len({(r.first_row) for r in rows})
