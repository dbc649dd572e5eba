"""Line dedup by a segment-partition edit join.

Two lines within edit distance d share a segment: cut one line into d + 1 segments, and the other holds
one of them unchanged, near the same place. Each line is indexed by its segments, with its length, and
probes the segments of lines as long as itself or up to d shorter, at those starts only where a segment
can still be the first unchanged one. Lines that meet are verified with a banded bit-parallel edit
distance. Linked lines form classes; of each class, and of lines that repeat, the first stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatwise.llm.common import SPACES, components, fresh_name, lookup, quoted, stage

DISTANCE = 2

#: Places of the bitmap that tells lines apart that may have met another (4 MB).
SIEVE_BITS = 25

#: Character pairs that one edit changes at most; lines that differ in more of them per edit aren't compared.
PAIRS_OF_EDIT = 4
CHARS_AT_ONCE = 1 << 21

#: Texts whose lines and keys a worker holds at a time.
ROWS_AT_ONCE = 1 << 9

#: Shorter lines are linked by exact equality alone: two edits may make another line of them.
LEAST_CHARS = 24


# --- keys ----------------------------------------------------------------------------------------------

def segments(length: int, distance: int) -> list[tuple[int, int]]:
    """(start, length) of the distance + 1 segments of a line; the last ones are longer by one."""
    n = distance + 1
    short, longer = length // n, length % n
    out, at = [], 0
    for k in range(n):
        size = short + (k >= n - longer)
        out.append((at, size))
        at += size
    return out


def probes(length: int, distance: int) -> list[tuple[int, int, int, int]]:
    """(other's length, segment, start, size) at which a line of this length can hold another's first unchanged segment."""
    out = []
    for shorter in range(min(distance, length) + 1):
        for k, (at, size) in enumerate(segments(length - shorter, distance)):
            left, right = k, distance - k  # edits that may come before, and after
            low = max(0, at - left, at + shorter - right)
            high = min(length - size, at + left, at + shorter + right)
            out += [(length - shorter, k, start, size) for start in range(low, high + 1)]
    return out


@lru_cache(maxsize=1 << 13)
def _index_places(length: int, distance: int) -> list[tuple[int, int, int]]:
    """(start, end, seed) of the parts of a line of this length that are its index keys."""
    return [(at, at + size, length * 64 + k) for k, (at, size) in enumerate(segments(length, distance))]


@lru_cache(maxsize=1 << 13)
def _probe_places(length: int, distance: int) -> list[tuple[int, int, int]]:
    """(start, end, seed) of the parts of a line of this length that are its probe keys."""
    return [(at, at + size, other * 64 + k) for other, k, at, size in probes(length, distance)]


def _part_keys(line: str, places: list[tuple[int, int, int]]) -> list[int]:
    if line.isascii():  # a byte for each character: parts are cut from the bytes
        raw = line.encode()
        return [xxhash.xxh64_intdigest(raw[start:end], seed) for start, end, seed in places]
    return [xxhash.xxh64_intdigest(line[start:end].encode("utf-8", "surrogatepass"), seed) for start, end, seed in places]


def index_keys(line: str, distance: int) -> list[int]:
    return _part_keys(line, _index_places(len(line), distance))


def probe_keys(line: str, distance: int) -> list[int]:
    return _part_keys(line, _probe_places(len(line), distance))


# --- verification --------------------------------------------------------------------------------------

def within(a: str, b: str, distance: int) -> bool:
    """Whether the edit distance of a and b is at most ``distance``: bit-parallel in a band of 2 * distance + 1 diagonals.

    After the common ends are cut off, column j of the band holds, one bit a row, where the distance rises
    and falls downward; a column follows from the one before with a few operations on one small number.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > distance:
        return False
    n = len(a)
    at = 0
    while at < n and a[at] == b[at]:
        at += 1
    a, b = a[at:], b[at:]
    while a and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a:
        return len(b) <= distance
    width = 2 * distance + 1
    full = (1 << width) - 1
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << (i + distance)
    # Bit r of column j is row j - distance + r of a; rows before a's first are outside and never match.
    up, down = full >> distance << distance, 0
    rows = len(a)
    found = min(distance, rows)  # at the band's lowest row, or at the last row of a
    for j, c in enumerate(b):
        match = (where.get(c, 0) >> j) & full
        same = ((((match & up) + up) ^ up) | match | down) & full
        rise = down | ~(same | up)
        fall = same & up
        lowest = j + distance
        if lowest < rows:  # the band's lowest row moves down along its diagonal
            found += not same >> (width - 1) & 1
        else:  # below a's last row: follow that row instead
            r = width - 2 - (lowest - rows)
            found += (rise >> r & 1) - (fall >> r & 1)
        up = (fall | ~((same >> 1) | rise)) & full
        down = (same >> 1) & rise & full
    return found <= distance


# --- the join ------------------------------------------------------------------------------------------

def _numbered(docs: DataFrame) -> DataFrame:
    """``doc, text``: doc is the id and a hash of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"),
                                F.xxhash64(text).alias("text")).alias("doc"), text.alias("text"))


def _lines(text: str, least_chars: int) -> list[tuple[int, str]]:
    """(number, line without outer white space) of each line that is long enough."""
    return [(k, y) for k, x in enumerate(text.split("\n")) if len(y := x.strip(SPACES)) >= least_chars]


def _strings(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of few rows."""
    for at in range(0, batch.num_rows, ROWS_AT_ONCE):
        yield batch.slice(at, ROWS_AT_ONCE)


def _id(line: str) -> int:
    x = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)
    return x if x < 1 << 63 else x - (1 << 64)


def _occurrences(docs: DataFrame, least_chars: int) -> DataFrame:
    """``doc, line_no, id`` of each line that is long enough."""
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            row, number, own = [], [], []
            for n, text in enumerate(_strings(batch.column(1))):
                for k, line in _lines(text, least_chars):
                    row.append(n)
                    number.append(k)
                    own.append(_id(line))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(own, pa.int64())],
                ["doc", "line_no", "id"])

    return docs.mapInArrow(run, f"doc {kind}, line_no int, id long")


def parities(lines: list[str]) -> np.ndarray:
    """64 bits for each line: whether the number of its hashed character pairs in each bin is odd.

    One edit takes away at most two pairs and adds at most two, so it turns at most ``PAIRS_OF_EDIT`` bits.
    """
    out = np.zeros(len(lines), dtype=np.uint64)
    start = 0
    while start < len(lines):
        end, size = start, 0
        while end < len(lines) and (end == start or size + len(lines[end]) <= CHARS_AT_ONCE):
            size += len(lines[end])
            end += 1
        own = lines[start:end]
        c = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        long = np.array([len(x) for x in own])
        after = np.cumsum(long)
        bits = np.zeros(len(c), dtype=np.uint64)  # of each character and the next
        place = (c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)) >> np.uint32(26)
        bits[:-1] = np.uint64(1) << place.astype(np.uint64)
        bits[after[long > 0] - 1] = 0  # the next character is another line's
        out[start:end][long > 0] = np.bitwise_xor.reduceat(bits, (after - long)[long > 0]) if len(c) else 0
        start = end
    return out


def _keys(docs: DataFrame, least_chars: int, distance: int, of_line) -> DataFrame:
    """``key, id, pairs``: the distinct keys of lines, dealt out by key; repeated lines count once in a batch before that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            for part in _parts(batch):
                key, own, fresh, many = [], [], [], []
                for text in _strings(part.column(0)):
                    for _, line in _lines(text, least_chars):
                        number = _id(line)
                        if number not in seen:
                            seen.add(number)
                            keys = of_line(line, distance)
                            key += keys
                            own.append(number)
                            fresh.append(line)
                            many.append(len(keys))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(key, dtype=np.uint64).view(np.int64)),
                     *[pa.array(np.repeat(x, many)) for x in (np.array(own, dtype=np.int64), parities(fresh).view(np.int64))]],
                    ["key", "id", "pairs"])

    return docs.select("text").mapInArrow(run, "key long, id long, pairs long").repartition("key").dropDuplicates(["key", "id"])


def _sieve(ids: DataFrame, bits: int = SIEVE_BITS) -> np.ndarray:
    """A bitmap of a fixed size with the place of every id set; others may share a place."""
    part = 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // part), pa.array(at % part)], ["part", "bit"])

    def merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(part, dtype=np.uint8)
        out[rows["bit"].to_numpy()] = 1
        return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(out).tobytes()]})

    places = ids.select("id").mapInArrow(run, "part long, bit long").distinct()
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for row in places.groupBy("part").applyInPandas(merged, "part long, bits binary").collect():  # bits / 8 bytes at most
        at = row["part"] * part // 8
        out[at:at + part // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def _texts(docs: DataFrame, least_chars: int, sieve: np.ndarray, bits: int = SIEVE_BITS) -> DataFrame:
    """``id, line`` of the lines whose place is set in the sieve, each once in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {}
            for text in (x for part in _parts(batch) for x in _strings(part.column(0))):
                for _, line in _lines(text, least_chars):
                    number = _id(line)
                    at = (number & (1 << 64) - 1) >> (64 - bits)
                    if sieve[at >> 3] >> (7 - (at & 7)) & 1:
                        found[line] = number
            yield pa.RecordBatch.from_arrays([pa.array(list(found.values()), pa.int64()), pa.array(list(found), pa.string())], ["id", "line"])

    return docs.select("text").mapInArrow(run, "id long, line string")


def _verified(pairs: DataFrame, distance: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [within(a, b, distance) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("a", "b", "line_a", "line_b").mapInArrow(run, "a long, b long")


def links(docs: DataFrame, distance: int = DISTANCE, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Pairs (a, b), a < b, of ids of different lines of the texts of ``docs`` within ``distance`` edits."""
    left, right = (_keys(docs, least_chars, distance, f) for f in (index_keys, probe_keys))
    left = left.select("key", F.col("id").alias("a"), F.col("pairs").alias("pairs_a"))
    right = right.select("key", F.col("id").alias("b"), F.col("pairs").alias("pairs_b"))
    alike = F.bit_count(F.col("pairs_a").bitwiseXOR(F.col("pairs_b"))) <= PAIRS_OF_EDIT * distance
    met = (left.join(right, "key").filter("a <> b").filter(alike).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    met = stage(met, "met")
    needed = met.select(F.col("a").alias("id")).unionByName(met.select(F.col("b").alias("id"))).distinct()
    # Few lines meet another; a bitmap of a fixed size keeps most others out of the join that fetches their texts.
    texts = _texts(docs, least_chars, _sieve(needed))
    texts = stage(texts.join(needed, "id", "left_semi").distinct(), "texts")
    pairs = (met.join(texts.select(F.col("id").alias("a"), F.col("line").alias("line_a")), "a")
             .join(texts.select(F.col("id").alias("b"), F.col("line").alias("line_b")), "b"))
    return _verified(pairs, distance).distinct()


def dropped_lines(docs: DataFrame, distance: int = DISTANCE, least_chars: int = LEAST_CHARS) -> DataFrame:
    """One row per line that goes: ``doc, line_no, keep_doc, keep_line`` (the first line of its class, which stays)."""
    docs = _numbered(docs)
    classes = components(stage(links(docs, distance, least_chars), "links"))
    rows = stage(_occurrences(docs, 1), "occurrences")
    lines = rows.groupBy("id").agg(F.min(F.struct("doc", "line_no")).alias("first"), F.count("*").alias("n"))
    named = (lines.join(classes.withColumnRenamed("node", "id"), "id", "left")
             .withColumn("class", F.coalesce("component", "id")))
    named = stage(named.filter("n > 1 OR component IS NOT NULL").select("id", "class", "first"), "classes")
    least = named.groupBy("class").agg(F.min("first").alias("least"))
    keep = lookup(named, least, ["class"], F.col("id")).select("id", "least")
    rows = lookup(rows, keep, ["id"], F.struct("doc", "line_no"))
    goes = F.col("least").isNotNull() & (F.col("least") != F.struct("doc", "line_no"))
    return rows.filter(goes).select("doc", "line_no", F.col("least.doc").alias("keep_doc"), F.col("least.line_no").alias("keep_line"))


def dedup(docs: DataFrame, distance: int = DISTANCE, least_chars: int = LEAST_CHARS) -> DataFrame:
    """The rows of ``docs`` with ``text`` less the lines that repeat an earlier one, and what went.

    Adds ``n_lines``, and ``gone``: an array of (line, keep_id, keep_line), the line's number from 0 and the
    place of the line that stays. Lines are compared without outer white space; lines within ``distance``
    edits are linked, directly or over others, lines under ``least_chars`` characters only to equal ones, and
    of each class the first by (doc_id, line) stays. Lines of white space alone stay. Documents stay, also those left without text; null text is kept.
    Rows that repeat both id and text are one document and keep the same lines. Null ids come last. An
    empty table gives an empty result; columns named alike are replaced, others kept.
    """
    gone = (dropped_lines(docs, distance, least_chars).groupBy("doc")
            .agg(F.sort_array(F.collect_set(F.struct(
                F.col("line_no").alias("line"), F.col("keep_doc.doc_id").alias("keep_id"), F.col("keep_line")))).alias("gone"))
            .select(F.col("doc.doc_id").alias("_lost_id"), F.col("doc.text").alias("_lost_hash"), "gone"))
    own = [c for c in docs.columns if c not in ("gone", "n_lines")]
    text, hash_ = F.coalesce(F.col("text").cast("string"), F.lit("")), fresh_name(docs, "_text_hash")
    rows = docs.select(*[F.col(quoted(c)) for c in own], F.xxhash64(text).alias(hash_))
    at_id, at_hash = (fresh_name(rows, c) for c in ("_lost_id", "_lost_hash"))
    gone = gone.withColumnsRenamed({"_lost_id": at_id, "_lost_hash": at_hash})
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col(at_id)) & (F.col(hash_) == F.col(at_hash)), "left").drop(at_id, at_hash, hash_)
    numbers = F.transform("gone", lambda x: x["line"])
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, k: ~F.array_contains(numbers, k)), "\n")
    size = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    return rows.withColumn("n_lines", size.cast("long")).withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left))
