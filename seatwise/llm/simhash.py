"""SimHash near-dedup by a segment-popcount embedding.

A fingerprint becomes a point: the bit count of each of its segments. The Manhattan distance of two
points is never above the Hamming distance of their fingerprints. With the segments dealt into blocks,
two points within distance d lie, in at least one block, within d // blocks of each other; the blocks are
so many that this is 0 or 1. A grid of unit cells over each block is then joined: a point stands in its
own cell and visits those cells where one count is higher by one. Pairs that meet are held to the whole
Manhattan distance and then to the exact Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatwise.llm.common import components, fresh_name, lookup, quoted, row_ids, stage

SHINGLE = 3
MAX_BITS = 3
SEED = 42

#: Segments of two bits; LOW has the lower bit of each.
FIELDS = 32
LOW = 0x5555555555555555

#: Shingles whose bits are counted at once.
STEP = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[len(words) - n:] - 1).tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, STEP):
        h = np.array([digest(line[s:e], SEED) for s, e in zip(starts[at:at + STEP], stops[at:at + STEP])], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, row, fp`` of ``doc_id, row, text``: fp is the fingerprint as a signed 64-bit number."""
    rows = docs.select("doc_id", "row", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(2)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], ["doc_id", "row", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, row long, fp long")


def _long(value: int) -> Column:
    return F.lit(value if value < 1 << 63 else value - (1 << 64)).cast("long")


def point(fp: Column) -> Column:
    """The bit count of each two-bit segment, in unary (00, 01, 11) in its place.

    The bits in which two such numbers differ are the Manhattan distance of their points.
    """
    high = F.shiftrightunsigned(fp, 1)
    one, two = fp.bitwiseOR(high).bitwiseAND(_long(LOW)), fp.bitwiseAND(high).bitwiseAND(_long(LOW))
    return one.bitwiseOR(F.shiftleft(two, 1))


def _step_up(at: Column, field: int) -> Column:
    """The point whose count in ``field`` is higher by one; null where that is no count."""
    low = _long(1 << 2 * field)
    up = at.bitwiseOR(low).bitwiseOR(F.shiftleft(at.bitwiseAND(low), 1))
    return F.when(up != at, up)


def links(points: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b) of nodes whose distinct fingerprints differ in at most ``max_bits`` bits.

    ``points``: ``fp`` (distinct) and ``node``. A pair may come more than once.
    """
    blocks = max_bits // 2 + 1
    bounds = [FIELDS * k // blocks for k in range(blocks + 1)]
    radius = max_bits // blocks
    cells = []
    for k, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        mask = _long(((1 << 2 * (hi - lo)) - 1) << 2 * lo)
        at = point(F.col("fp")).bitwiseAND(mask)
        own = F.struct(at.alias("cell"), F.lit(True).alias("home"))
        visits = [F.when(_step_up(at, i).isNotNull(), F.struct(_step_up(at, i).alias("cell"), F.lit(False).alias("home")))
                  for i in range(lo, hi)] if radius else []
        cells.append(points.select("node", "fp", F.explode(F.array_compact(F.array(own, *visits))).alias("at"))
                     .select("node", "fp", F.lit(k).alias("block"), "at.cell", "at.home"))
    grid = cells[0]
    for more in cells[1:]:
        grid = grid.unionByName(more)
    home = grid.filter("home").select("block", "cell", F.col("fp").alias("fp_a"), F.col("node").alias("a"))
    guest = grid.select("block", "cell", F.col("fp").alias("fp_b"), F.col("node").alias("b"), "home")
    near = F.bit_count(point(F.col("fp_a")).bitwiseXOR(point(F.col("fp_b")))) <= max_bits
    exact = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= max_bits
    met = home.join(guest, ["block", "cell"]).filter("not home or fp_a < fp_b")
    return met.filter(near).filter(exact).select("a", "b")


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id",
               text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id, row, first_row``.

    ``component_id`` is the smallest id that links of at most ``max_bits`` bits reach, itself included;
    ``row`` numbers the rows (or is ``row_col``, distinct numbers), ``first_row`` is the row that stays of its component. Null and empty texts
    have fingerprint 0, linked like any other; null ids come after all others, and repeated ids are rows
    of their own. An empty table gives an empty result; other columns play no part.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias("row") for c in [row_col] if c])
    rows = stage(fingerprints(own if row_col else row_ids(own, "row"), shingle), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row"))
    points = stage(rows.groupBy("fp").agg(first.alias("first")), "points")
    nodes = points.select("fp", F.col("first.row").alias("node"), F.col("first").alias("own"))
    reached = components(links(nodes.select("fp", "node"), max_bits))
    member = nodes.join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = member.groupBy("component").agg(F.min("own").alias("least"))
    named = member.select("fp", "component").join(least, "component").select("fp", "least")
    return lookup(rows, named, ["fp"], F.col("row")).select(
        "doc_id", "fp", F.col("least.doc_id").alias("component_id"), "row", F.col("least.row").alias("first_row"))


def keep_first(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one stays of each component; see :func:`near_dedup`."""
    number = fresh_name(docs, "_row_number")
    numbered = stage(row_ids(docs, number), "numbered")
    rows = near_dedup(numbered, shingle, max_bits, row_col=number)
    first = rows.filter("row = first_row").select(F.col("row").alias(number))
    return numbered.join(first, number, "left_semi").select(*[F.col(quoted(c)) for c in docs.columns])


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
