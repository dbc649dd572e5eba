"""Periodic runs of words by recursive frequency splitting.

A run is a stretch of consecutive words with smallest period q, at least ``times`` periods long, that no
neighbouring word extends. Each word of a run occurs ``times`` times in it at least, so a word that occurs
more rarely in a segment belongs to no run of that segment and splits it; the pieces are counted anew, and
split again, until every word left is frequent in its own segment. Only those segments are scanned, lag by
lag, for stretches of words that equal those one lag on.

A document is one row's work and no row moves: the operator is one pass over the table, without a shuffle.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A run has at least so many words, and so many periods.
LEAST_WORDS = 6
TIMES = 4


# --- runs of one sequence ------------------------------------------------------------------------------

def frequent_segments(ids: np.ndarray, least: int = LEAST_WORDS, times: int = TIMES) -> list[tuple[int, int]]:
    """[start, end) of the segments, in order, in which every word occurs at least ``times`` times and which have ``least`` words."""
    out, open_ = [], [(0, len(ids))]
    while open_:
        lo, hi = open_.pop()
        if hi - lo < max(least, times):
            continue
        _, at, count = np.unique(ids[lo:hi], return_inverse=True, return_counts=True)
        rare = np.flatnonzero(count[at] < times) + lo
        if not len(rare):
            out.append((lo, hi))
            continue
        starts, ends = np.concatenate(([lo], rare + 1)), np.concatenate((rare, [hi]))
        long = ends - starts >= max(least, times)
        open_.extend(zip(starts[long].tolist(), ends[long].tolist()))
    return sorted(out)


def _reach(ids: np.ndarray, at: int, lag: int, end: int) -> tuple[int, int]:
    """[a, b) around ``at``, where words equal those ``lag`` on: the longest such stretch inside the segment."""
    size, b = 64, at
    while b + lag < end:
        stop = min(end - lag, b + size)
        differ = ids[b:stop] != ids[b + lag:stop + lag]
        if differ.any():
            b += int(differ.argmax())
            break
        b, size = stop, 2 * size
    size, a = 64, at
    while a > 0:
        start = max(0, a - size)
        differ = (ids[start:a] != ids[start + lag:a + lag])[::-1]
        if differ.any():
            a -= int(differ.argmax())
            break
        a, size = start, 2 * size
    return a, b


def lag_scan(ids: np.ndarray, least: int = LEAST_WORDS, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one segment, exactly.

    A run of period q equals itself one lag on over (times - 1) * q words, so over ``times - 1`` multiples
    of q in a row: lag q is tried at its multiples first, n / q comparisons, and followed to both sides
    from those that pass. A stretch whose smallest period is a part of q is the run of that part, found
    at a smaller lag, with the same ends: ``times`` periods of q inside a run that is known are its own.
    """
    n, out, seen = len(ids), [], set()
    inside = np.zeros(n, dtype=np.int64)  # where the longest known run around each word ends
    for q in range(1, n // times + 1):
        at = ids[::q]
        same = at[1:] == at[:-1]
        hit = same[:len(same) - times + 2].copy()
        for k in range(1, times - 1):
            hit &= same[k:len(same) - times + 2 + k]
        hits, upto = np.flatnonzero(hit), 0
        if out:
            hits = hits[inside[hits * q] < (hits + times) * q]
        for k in hits.tolist():
            if k * q < upto:
                continue
            a, b = _reach(ids, k * q, q, n)
            upto = max(b, k * q + 1)
            if b - a + q >= max(least, times * q) and (a, b + q) not in seen:
                seen.add((a, b + q))
                np.maximum(inside[a:b + q], b + q, out=inside[a:b + q])
                out.append((a, b - a + q, q))
    return out


def runs(words: list[bytes], least: int = LEAST_WORDS, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the words, by start, then period."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    if len(ids) < max(least, times) or np.bincount(ids).max() < times:
        return []
    found = []
    for lo, hi in frequent_segments(ids, least, times):
        found += [(lo + a, length, q) for a, length, q in lag_scan(ids[lo:hi], least, times)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, q in found:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


# --- documents -----------------------------------------------------------------------------------------

def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a periodic tail, where the id's checksum asks for one; null ids ask for none."""
    h = 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


RUN = "struct<start: bigint, length: bigint, period: bigint>"


def collapse(docs: DataFrame, least: int = LEAST_WORDS, times: int = TIMES, plant: bool = False) -> DataFrame:
    """One row per document: ``doc_id, runs, text``, the text being the kept words joined by one space.

    ``runs`` holds (start, length, period) in words, by start, then period. Null and empty texts have no
    words, no runs and an empty text; repeated rows and null ids are rows of their own; an empty table
    gives an empty result; other columns of ``docs`` play no part. With ``plant``, see :func:`planted`.
    """
    return _per_document(docs, least, times, plant, f"runs array<{RUN}>, text string", lambda found, words, stay: [
        [{"start": a, "length": b, "period": q} for a, b, q in found],
        b" ".join(w for w, s in zip(words, stay) if s).decode("utf-8", "replace")])


DIGEST = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _digest(found, words, stay) -> list:
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listed = "".join(f"{a},{b},{q}\n" for a, b, q in found).encode()
    text = b" ".join(words if not found else [w for w, s in zip(words, stay) if s])
    return [len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
            hashlib.sha256(listed).hexdigest(), hashlib.sha256(text).hexdigest()]


def digests(docs: DataFrame, least: int = LEAST_WORDS, times: int = TIMES, plant: bool = False) -> DataFrame:
    """Per document: the number of runs, the run with the most periods, and checksums of the runs and of the kept words.

    The run with the greatest length / period is compared exactly; ties go to the smallest start, then
    period. Odd rows as in :func:`collapse`; without runs the run's four columns are null.
    """
    return _per_document(docs, least, times, plant, DIGEST, _digest)


def _per_document(docs: DataFrame, least: int, times: int, plant: bool, columns: str, result) -> DataFrame:
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {columns}"
    kinds = list(to_arrow_schema(StructType.fromDDL(schema)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = text.as_py().split()
                if plant:
                    words = planted(words, doc_id)
                found = runs(words, least, times)
                made.append(result(found, words, kept(len(words), found)))
            columns = list(zip(*made)) or [()] * (len(kinds) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k.type) for c, k in zip(columns, kinds[1:])]], [k.name for k in kinds])

    return rows.mapInArrow(run, schema)
