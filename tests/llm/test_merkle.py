from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from odd_rows import ODD

from seatwise.llm import merkle as M


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(row, more=0):
    doc_id, source, lang, n_chars, text = row
    return sha(map(field, (doc_id, source, lang, None if n_chars is None else n_chars + more, text)))


def levels(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(out[-1][i:i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def up(at, tree, arity, new):
    """Siblings from the bottom, and the node that ``new`` leads to, hashing whole runs."""
    siblings = []
    for level in tree[:-1]:
        first = at // arity * arity
        run = level[first:first + arity]
        siblings += run[:at - first] + run[at - first + 1:]
        new = sha(run[:at - first] + [new] + run[at - first + 1:])
        at //= arity
    return siblings, new


def slow(rows, arity, tampered):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: levels([leaf(r) for r in order if r[2] == lang], arity) for lang in langs}
    over = levels([trees[lang][-1][0] for lang in langs], arity)
    out = []
    for lang in langs:
        for at, r in enumerate(r for r in order if r[2] == lang):
            new = leaf(r, 1) if tampered(r[0]) else leaf(r)
            below, sub = up(at, trees[lang], arity, new)
            above, root = up(langs.index(lang), over, arity, sub)
            out.append((r[0], leaf(r), trees[lang][-1][0], over[-1][0], sha(below + above), root, root == over[-1][0]))
    return out


def key(row):
    return tuple((x is None, x) for x in row)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, at long, size long, block int"


def frame(spark, rows):
    return spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], "x", 1, 2, 3) for r in rows], SCHEMA)


@pytest.mark.parametrize("arity,height,n", [(2, 12, 60), (2, 2, 90), (3, 2, 150), (2, 1, 33), (5, 1, 40)])
def test_against_whole_trees(spark, arity, height, n):
    """Blocks of a few levels, so that three tiers and more are needed; languages of very different sizes."""
    rng = random.Random(n)
    rows = [(rng.choice([i, i, None]), rng.choice(["s", None, "é:"]), rng.choice(["en"] * 6 + ["de", None, "z", "é", ""]),
             rng.choice([None, i]), rng.choice([None, "", f"t {i}", "日本"])) for i in range(n)]
    rows += rows[:7]
    hit = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 0
    out = M.documents_manifest(frame(spark, rows), "crc32(cast(doc_id as string)) % 3 = 0", arity, height).collect()
    assert sorted(map(tuple, out), key=key) == sorted(slow(rows, arity, hit), key=key)
    assert {r.verified for r in out} == {True, False}


def test_one_row_one_language_and_empty_table(spark):
    one = [(7, "s", "en", 3, "abc")]
    r = M.documents_manifest(frame(spark, one)).first()
    assert r.leaf == r.subroot == r.root == r.folded_root == leaf(one[0]) and r.verified and r.proof_sha256 == sha([])
    assert M.documents_manifest(frame(spark, [])).collect() == []


def test_odd_rows(spark):
    rows = [(r[0], "s", None, 2**63 - 1, r[1]) for r in ODD]
    out = M.documents_manifest(frame(spark, rows), "true", 2, 2).collect()
    assert sorted(map(tuple, out), key=key) == sorted(slow(rows, 2, lambda i: True), key=key)
    assert not any(r.verified for r in out)


def test_folding_uses_right_siblings_only():
    """The path of a node holds a state in place of everything to its left."""
    nodes = [hashlib.sha256(b"%d" % i).hexdigest().encode() for i in range(9)]
    tree = M.Block(nodes, 2, 3)
    for at in range(9):
        path = [(state, None, right) for state, _, right in tree.path(at)]
        assert M.fold(nodes[at], path) == tree.root and M.fold(b"0" * 64, path) != tree.root
