from __future__ import annotations

import hashlib
import random
import re

from odd_rows import ODD
from pyspark.sql import functions as F

from seatwise.llm import chunk_dedup as C


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def expected(rows):
    groups = {}
    for n, (i, t) in enumerate(rows):
        groups.setdefault(norm(t), []).append((i is None, i or 0, n))
    out = []
    for n, (i, t) in enumerate(rows):
        g = sorted(groups[norm(t)])
        keep = rows[g[0][2]][0]
        out.append((i, keep, len(g), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def run(df):
    return C.exact_dedup(df).collect()


def test_odd_rows(docs):
    got = run(docs(ODD))
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == expected(ODD)
    assert sum(r.kept for r in got) == len({norm(t) for _, t in ODD})


def test_empty_table(docs):
    assert run(docs([])) == []


def test_long_copies_and_one_letter_changes(docs):
    rng = random.Random(3)
    words = ["that", "mail", "lines", "dream", "of", "hams"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4000))) for _ in range(8)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t.replace(" ", "\n", 3)) for i, t in enumerate(base)]
    rows += [(200 + i, t[:-1] + "z") for i, t in enumerate(base)]
    got = run(docs(rows))
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == expected(rows)


def test_chunks_join_to_the_text(spark, docs):
    rows = docs(ODD).select(C.normalise(F.col("text")).alias("t")).select("t", C.chunks(F.col("t")).alias("c")).collect()
    for r in rows:
        assert "".join(r.c) == r.t and all(len(x) <= C.MOST for x in r.c)


def test_plan_has_no_python(docs):
    plan = C.exact_dedup(docs(ODD))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
