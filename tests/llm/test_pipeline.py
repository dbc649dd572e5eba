from __future__ import annotations

import inspect

import corpus_pipeline as C
import pytest
from odd_rows import ODD

from seatwise.llm import queries
from seatwise.llm.common import stage

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [name for name, _ in C.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "source_mix", "packing"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in C.STAGES)


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_stages_take_odd_rows(spark, docs, rows):
    df = docs(rows)
    for name, step in C.STAGES:
        out = stage(step(spark, df, SF), name)
        if name != "packing":
            assert out.columns == df.columns
            df = out
    assert out.count() >= df.count()


CLASHES = "n_lines long, gone string, _id long, _hash string, _own string, _row_number long, _copy long, `a.b` long, own string, row long, repeats long"


def test_stages_keep_columns_of_any_name(spark):
    """Columns that are named like a stage's helpers, or with a dot, pass through; tables without n_chars too."""
    schema = f"doc_id long, text string, lang string, source string, {CLASHES}"
    rows = [(i, f"a line of the document number {i}\n" + "one line that many documents have\n" * (i % 2) + "w " * i, "en", "s",
             7, "g", i, "h", "o", 9, 3, 4, "own", 1, 2) for i in range(30)]
    df = spark.createDataFrame(rows, schema)
    for name, step in C.STAGES[:-1]:
        out = stage(step(spark, df, SF), name)
        assert out.columns == df.columns and out.schema == df.schema, name
        assert {tuple(r)[4:] for r in out.collect()} <= {r[4:] for r in rows} and out.count(), name
        df = out


def test_run_on_the_smallest_table(spark):
    out = C.run(spark, SF).collect()
    assert out and all(0 <= r.offset < 2048 and 0 < r.length <= 2048 for r in out)
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out)
