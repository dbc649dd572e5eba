from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from odd_rows import ODD

from seatwise.llm import line_dedup as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("ab", max_size=14), st.text("abc", max_size=14), st.integers(0, 5))
def test_banded_distance(a, b, k):
    assert L.within(a, b, k) == (distance(a, b) <= k)


@settings(max_examples=400, deadline=None)
@given(st.text("abc", min_size=4, max_size=20), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 20), st.sampled_from("abc")), max_size=3))
def test_near_lines_always_meet(a, edits):
    b = list(a)
    for kind, at, c in edits:
        at = min(at, len(b) - 1)
        if kind == 0:
            b.insert(at, c)
        elif kind == 1 and len(b) > 4:
            b.pop(at)
        else:
            b[at] = c
    a, b = sorted([a, "".join(b)], key=len)
    if distance(a, b) <= 3 and a != b:
        assert set(L.index_keys(a, 3)) & set(L.probe_keys(b, 3))


def brute(rows, d, least):
    """First line of each class by union over all pairs."""
    rows = sorted(dict.fromkeys(rows), key=lambda r: (r[0] is None, r[0] or 0))
    occ = [(i, k, x.strip(" \t\n\r\x0b\x0c")) for i, t in rows for k, x in enumerate((t or "").split("\n"))]
    occ = [o for o in occ if o[2]]
    lines = list(dict.fromkeys(o[2] for o in occ))
    parent = list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(lines)):
        for j in range(i):
            if min(len(lines[i]), len(lines[j])) >= least and abs(len(lines[i]) - len(lines[j])) <= d and distance(lines[i], lines[j]) <= d:
                parent[find(i)] = find(j)
    number, first, gone = {x: n for n, x in enumerate(lines)}, {}, set()
    for i, k, x in occ:
        c = find(number[x])
        if c in first:
            gone.add((i, k, *first[c]))
        else:
            first[c] = (i, k)
    return gone


def test_classes_against_all_pairs(docs):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randint(20, 60))).strip() + "x" * 5 for _ in range(25)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(rng.randint(0, 6)):
            x = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                x[rng.randrange(len(x))] = rng.choice("abcde")
            own.append("  " * rng.randint(0, 1) + "".join(x))
        rows.append((i, "\n".join(own) + rng.choice(["", "\nshort", "\n\n", "\nshorn\n x"])))
    out = L.dedup(docs(rows)).collect()
    got = {(r.doc_id, g["line"], g["keep_id"], g["keep_line"]) for r in out for g in r.gone or []}
    assert got == brute(rows, L.DISTANCE, L.LEAST_CHARS)
    for r in out:
        dropped = {g["line"] for g in r.gone or []}
        text = dict(rows)[r.doc_id]
        assert r.text == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in dropped)


def test_odd_rows_and_empty_table(docs):
    line = "a line that is long enough to count"
    rows = [*ODD, (10, line), (11, f"{line}!\n{line}"), (11, f"{line}!\n{line}"), (None, line)]
    out = L.dedup(docs(rows)).collect()
    assert len(out) == len(rows)
    left = {r.doc_id: r.text for r in out if r.doc_id not in (2,)}
    assert left[10] == line and left[11] == "" and left[None] in ("", "a b") and left[5] is None
    assert L.dedup(docs([])).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text("abcé日", max_size=14), st.text("abcé日", max_size=14))
def test_edits_turn_few_parities(a, b):
    x, y = L.parities([a, b]).tolist()
    assert bin(x ^ y).count("1") <= L.PAIRS_OF_EDIT * distance(a, b)


def test_places_of_keys_are_worked_out_once_a_length(monkeypatch):
    asked, places = [], L.probes
    monkeypatch.setattr(L, "probes", lambda length, distance: asked.append(length) or places(length, distance))
    lines = ["x" * 4099 + c for c in "abc"] + ["é" * 4099 + "a"]
    keys = [L.probe_keys(line, 2) for line in lines]
    assert len(asked) <= 1
    assert keys == [[L.xxhash.xxh64_intdigest(line[at:at + size].encode(), n * 64 + k) for n, k, at, size in places(4100, 2)] for line in lines]


def test_keys_of_a_batch_leave_in_pieces():
    class Docs:  # hands out the function that Spark would run
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

        def repartition(self, *columns):
            return self

        def dropDuplicates(self, columns):
            return self.run

    texts = [f"line {k // 2} of these texts, twice each" for k in range(2000)]
    out = list(L._keys(Docs(), 24, 2, L.index_keys)(iter([L.pa.RecordBatch.from_arrays([L.pa.array(texts)], ["text"])])))
    assert max(b.num_rows for b in out) <= 3 * 512
    keys = [x for b in out for x in b.column(0).to_numpy().view("u8").tolist()]
    assert keys == [x for text in dict.fromkeys(texts) for x in L.index_keys(text, 2)]
