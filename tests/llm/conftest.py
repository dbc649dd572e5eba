from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, size long, keep_id long"

#: Clashing names for columns that operators must not confuse with their own.
EXTRA = (0.5, 7, 8, 9)


@pytest.fixture
def docs(spark):
    """Documents of (doc_id, text[, source]) with extra columns whose names clash with results."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), *EXTRA) for r in rows]
        return spark.createDataFrame(full, SCHEMA)
    return make
