from __future__ import annotations

from collections import defaultdict

from odd_rows import ODD

from seatwise.llm import mixing as M


def fill(sizes, weights, total, epochs):
    """Targets by clamping and dealing again, source by source."""
    target, capped = {}, set()
    while True:
        rest = total - sum(epochs * sizes[s] for s in capped)
        open_ = [s for s in sizes if s not in capped]
        level = rest / sum(weights[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * weights[s] > epochs * sizes[s]]
        if not over:
            break
        capped |= set(over)
    for s in sizes:
        target[s] = epochs * sizes[s] if s in capped else level * weights[s]
    return target


def test_targets_and_amounts(docs):
    rows = [(i, "w " * (1 + i % 7), ["b", "a", "c", None][i % 4] if i % 5 else "hot") for i in range(400)]
    got = M.mix(docs(rows)).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: M.WEIGHTS[k % 3] for k, s in enumerate(order)}
    target = fill(sizes, weights, 1.5 * sum(sizes.values()), 2)
    taken, source = defaultdict(int), {r[0]: r[2] for r in rows}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.repeats * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 7 for s in sizes)
    again = M.mix(docs(rows[::-1]).repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_odd_rows_and_empty_table(docs):
    got = M.mix(docs([(i, t, None if k % 2 else "s") for k, (i, t) in enumerate(ODD)])).collect()
    assert len(got) == len(ODD)
    assert M.mix(docs([])).collect() == []
    assert [r.taken for r in M.mix(docs([(1, ""), (2, None)])).collect()] == [0, 0]


def test_mixed_keeps_columns(docs):
    df = docs([(i, "a b c", "s") for i in range(10)])
    out = M.mixed(df)
    assert out.columns == df.columns and out.count() == 15
