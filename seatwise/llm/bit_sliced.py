"""Exact top-k inner products on a bit-sliced index.

The index holds rows in blocks; of each quantised attribute it stores the binary digits of all rows of a
block as bitmaps, the slices. For a query, the slices are added with bitmap arithmetic: each set digit of
a query component contributes that component's slices, moved up by the digit's place (complemented
slices where the component is negative, which shifts all scores of a block alike), and carry-save adders
bring the bitmaps of each place down to one. The slices of the score are then read from the most
significant downward, which keeps the rows that surely are among the top k and those that tie with the
boundary; the boundary's rows are settled by their exact scores and ids.
"""

from __future__ import annotations

import heapq
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatwise.llm.common import row_ids, stage

SCALE = 256.0
K = 5
BLOCK_ROWS = 16384
CHUNK_QUERIES = 256

#: Rows of a block whose scores are worked out with whole numbers of any size.
WIDE_ROWS = 4096

#: Scores beyond 38 digits rank as these, those beyond 64 bits are returned as the nearest 64-bit number.
MOST = 10 ** 38 - 1
LONGEST = (1 << 63) - 1

LONG = np.dtype("<i8")


def _quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``vec_id, q``: whole numbers as doubles; vectors null, or holding null or non-finite components, drop out."""
    x = F.col(vector_col).cast("array<double>")
    # floor of a double would stop at 64 bits; from 2 ** 52 on a double is whole
    q = F.transform(x, lambda c: F.when(F.abs(c * scale) < 2.0 ** 52, F.floor(c * F.lit(scale)).cast("double")).otherwise(c * F.lit(scale)))
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < float("inf")))
    return (vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(usable, F.lit(False)))
            .select(F.col(id_col).cast("long").alias("vec_id"), q.alias("q")))


def safe_bound(width: int) -> int:
    """Components below it, in vectors of so many, have scores of at most 62 bits."""
    return 1 << (62 - max(1, width).bit_length()) // 2


def _matrix(rows: list) -> np.ndarray:
    """Components of all rows; shorter vectors are filled with 0."""
    width = max(map(len, rows), default=0)
    return np.array([[*r, *[0] * (width - len(r))] for r in rows], dtype=LONG).reshape(len(rows), width)


def _blocks(rows: DataFrame, number: str, sliced: bool) -> DataFrame:
    """A row for each ``number``: an index block holds slices, a query block the components themselves."""

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        x, low, bits = _matrix(own["q"].tolist()), 0, 0
        if sliced:
            low = int(x.min(initial=0))
            bits = int((x - low).max(initial=0)).bit_length()
        data = slices(x - low, bits) if sliced else x
        return pd.DataFrame({number: [key[0]], "ids": [own["vec_id"].to_numpy(LONG).tobytes()], "width": [x.shape[1]],
                             "low": [low], "bits": [bits], "data": [data.tobytes()]})

    return rows.groupBy(number).applyInPandas(run, f"{number} long, ids binary, width int, low long, bits int, data binary")


def slices(x: np.ndarray, bits: int) -> np.ndarray:
    """(attribute, digit, word): bitmaps over the rows, 64 rows a word."""
    n, width = x.shape
    words = -(-n // 64)
    out = np.zeros((width, bits, words * 8), dtype=np.uint8)
    for b in range(bits):
        out[:, b, :-(-n // 8)] = np.packbits(((x >> b) & 1).astype(np.uint8).T, axis=1, bitorder="little")
    return out.view(np.uint64)


def add(query: np.ndarray, index: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Slices of the score by place from the lowest, and what to take from it: sum of query times attribute, moved.

    Three bitmaps of one place become one there and one a place up (a full adder) until each place has one.
    """
    bits = index.shape[1]
    places: list[list[np.ndarray]] = [[] for _ in range(bits)]
    moved = 0
    flip = ~index[query < 0] if (query < 0).any() else None
    size = np.abs(query)
    for sign, part in ((1, index[query > 0]), (-1, flip)):
        if part is None or not len(part):
            continue
        own = size[query > 0] if sign > 0 else size[query < 0]
        if sign < 0:
            moved += int(own.sum()) * ((1 << bits) - 1)
        for a in range(int(own.max()).bit_length()):
            use = (own >> a) & 1 == 1
            if not use.any():
                continue
            while len(places) < a + bits:
                places.append([])
            chosen = part[use]
            for b in range(bits):
                places[a + b].append(chosen[:, b])
    out, k = [], 0
    while k < len(places):
        here = np.concatenate(places[k]) if places[k] else None
        if here is None:
            out.append(np.zeros(index.shape[2], dtype=np.uint64))
            k += 1
            continue
        while len(here) > 1:
            if k + 1 == len(places):
                places.append([])
            if len(here) == 2:
                places[k + 1].append(here[:1] & here[1:])
                here = here[:1] ^ here[1:]
                break
            n = len(here) // 3
            x, y, z = here[:n], here[n:2 * n], here[2 * n:3 * n]
            xy = x ^ y
            places[k + 1].append((x & y) | (xy & z))
            here = np.concatenate([xy ^ z, here[3 * n:]])
        out.append(here[0])
        k += 1
    return out, moved


def select(score: list[np.ndarray], rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the rows surely among the top k, and of those that tie at the boundary."""
    sure, tied = np.zeros_like(rows), rows.copy()
    held = 0
    for digit in reversed(score):
        ones = tied & digit
        n = held + int(np.bitwise_count(ones).sum())
        if n > k:
            tied = ones
        else:
            sure |= ones
            tied &= ~digit
            held = n
            if n == k:
                return sure, np.zeros_like(rows)
    return sure, tied


def _positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _scores(score: list[np.ndarray], at: np.ndarray, moved: int) -> np.ndarray:
    word, bit = at // 64, (at % 64).astype(np.uint64)
    total = np.zeros(len(at), dtype=LONG)
    for place, digits in enumerate(score):
        total += ((digits[word] >> bit) & np.uint64(1)).astype(LONG) << place
    return total - moved


def top_of_block(queries: np.ndarray, query_ids: np.ndarray, index: np.ndarray, low: int, ids: np.ndarray, k: int
                 ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, row id, score) of each query's top k rows of one block, the query's own row left out."""
    width = max(queries.shape[1], index.shape[0])
    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    if index.shape[0] < width:  # attributes that no row of the block has are 0: their moved digits are those of -low
        zero = -low
        more = np.zeros((width - index.shape[0], index.shape[1], index.shape[2]), dtype=np.uint64)
        for b in range(index.shape[1]):
            if zero >> b & 1:
                more[:, b] = ~np.uint64(0)
        index = np.concatenate([index, more])
    full = np.zeros(index.shape[2] * 8, dtype=np.uint8)
    full[:-(-len(ids) // 8)] = np.packbits(np.ones(len(ids), dtype=np.uint8), bitorder="little")
    full = full.view(np.uint64)
    where: dict[int, list[int]] = {}
    asked = set(query_ids.tolist())
    for n, i in enumerate(ids.tolist()):
        if i in asked:
            where.setdefault(i, []).append(n)
    found = []
    for q, own in zip(queries, query_ids.tolist()):
        rows = full
        if own in where:
            rows = full.copy()
            for n in where[own]:
                rows[n // 64] &= ~np.uint64(1 << (n % 64))
        score, moved = add(q, index)
        sure, tied = select(score, rows, k)
        at = _positions(sure)
        left = k - len(at)
        if left > 0:
            edge = _positions(tied)
            at = np.concatenate([at, edge[np.argsort(ids[edge], kind="stable")[:left]]])
        found.append((np.full(len(at), own, dtype=LONG), ids[at], _scores(score, at, moved) + low * int(q.sum())))
    return tuple(np.concatenate(c) if found else np.zeros(0, LONG) for c in zip(*found)) if found else (np.zeros(0, LONG),) * 3


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(max(n, 1) - 1).cast("long"))


def top_k(vectors: DataFrame, query_filter: str = "vec_id % 50 = 0", k: int = K, scale: float = SCALE,
          block_rows: int = BLOCK_ROWS, chunk_queries: int = CHUNK_QUERIES, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """One row per query and hit: ``query_id, rank, vec_id, score``.

    Queries are the rows that ``query_filter`` (over ``vec_id``) selects, candidates all rows but those with
    the query's id. Scores that tie are ordered by the smaller id. Rows that repeat an id are candidates of
    their own, and one query. Components missing from shorter vectors count as 0. Vectors that are null,
    have no id, or hold null or non-finite components take no part; an empty table, or a query without
    candidates, has no rows. Other columns play no part.

    The index holds vectors whose scores surely fit 64-bit sums. The others, and queries like them, are
    scored with whole numbers of any size and join the ranking.
    """
    every = stage(row_ids(_quantised(vectors, id_col, vector_col, scale)), "quantised")
    every_asked = stage(every.filter(query_filter).groupBy("vec_id").agg(F.min("q").alias("q")), "asked")
    bound = safe_bound(every.agg(F.max(F.size("q"))).first()[0] or 1)
    fits = F.forall("q", lambda c: F.abs(c) < float(bound))
    rows, asked = (x.filter(fits).withColumn("q", F.col("q").cast("array<bigint>")) for x in (every, every_asked))
    blocks, chunks = -(-rows.count() // block_rows), -(-asked.count() // chunk_queries)
    index = _blocks(rows.withColumn("block", F.pmod(F.xxhash64("_row"), F.lit(max(blocks, 1)))), "block", sliced=True)
    queries = _blocks(asked.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(max(chunks, 1)))), "chunk", sliced=False)
    # Every block of rows meets every chunk of queries, one pair of them in memory at a time.
    left = stage(index, "index").withColumn("chunk", F.explode(_numbers(chunks)))
    right = stage(queries, "queries").withColumn("block", F.explode(_numbers(blocks)))

    def run(key: tuple, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame(columns=["query_id", "vec_id", "score"])
        r, q = rows.iloc[0], queries.iloc[0]
        ids = np.frombuffer(r["ids"], dtype=LONG)
        index = np.frombuffer(r["data"], dtype=np.uint64).reshape(r["width"], r["bits"], -(-len(ids) // 64))
        query_ids = np.frombuffer(q["ids"], dtype=LONG)
        components = np.frombuffer(q["data"], dtype=LONG).reshape(len(query_ids), q["width"])
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), top_of_block(
            components, query_ids, index, int(r["low"]), ids, k))))

    near = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInPandas(
        run, "query_id long, vec_id long, score long")
    near = near.withColumn("exact", F.col("score").cast("decimal(38,0)")).drop("score")
    for own, others in ((every_asked.filter(~fits), every), (every_asked.filter(fits), every.filter(~fits))):
        if not own.isEmpty() and not others.isEmpty():
            near = near.unionByName(_wide(own, others, k, chunk_queries))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("exact"), "vec_id"))
    score = F.greatest(F.least("exact", F.lit(Decimal(LONGEST))), F.lit(Decimal(-LONGEST - 1)))
    return near.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.cast("long").alias("score"))


def _wide(asked: DataFrame, rows: DataFrame, k: int, chunk_queries: int) -> DataFrame:
    """``query_id, vec_id, exact``: each query's best rows of each block, by whole numbers of any size."""
    blocks, chunks = -(-rows.count() // WIDE_ROWS), -(-asked.count() // chunk_queries)
    left = rows.withColumn("block", F.pmod(F.xxhash64("_row"), F.lit(blocks))).withColumn("chunk", F.explode(_numbers(chunks)))
    right = asked.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks))).withColumn("block", F.explode(_numbers(blocks)))

    def run(key: tuple, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        candidates = [(int(i), [int(c) for c in q]) for i, q in zip(rows["vec_id"], rows["q"])]
        for own, q in zip(queries["vec_id"], queries["q"]):
            q = [int(c) for c in q]
            scores = ((-sum(a * b for a, b in zip(q, c)), i) for i, c in candidates if i != own)
            found += [(int(own), i, Decimal(max(-MOST, min(MOST, -s)))) for s, i in heapq.nsmallest(k, scores)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "exact"])

    return left.select("block", "chunk", "vec_id", "q").groupBy("block", "chunk").cogroup(
        right.select("block", "chunk", "vec_id", "q").groupBy("block", "chunk")).applyInPandas(
        run, "query_id long, vec_id long, exact decimal(38,0)")


ORACLE_SQL = """
WITH q AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum([a.q[i] * b.q[i] for i in range(1, 1 + least(len(a.q), len(b.q)))]) AS BIGINT) AS score
  FROM q a, q b WHERE a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
