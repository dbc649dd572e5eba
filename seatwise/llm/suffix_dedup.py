"""Removal of repeated passages by distributed prefix doubling.

Every string of ``length`` bytes holds one anchor: the start of its least quarter-length gram by a hash, so
equal strings have it at the same place. Positions are ranked by growing prefixes, and those whose rank is
unique drop out:

1. The anchors of all texts by their gram. Spark counts the grams; an anchor whose gram stands nowhere else
   is in no repeated string.
2. The anchors left by their whole context, the strings that share the anchor. A context that stands twice
   is repeated as a whole. One that stands once is open if its gram stands in other contexts too.
3. The positions of open contexts. Those of one gram meet in one task, where pairs (rank at a position, rank
   one offset on) are sorted and ranked anew, at offsets that double, until they are unique or cover the
   length. The contexts of a gram with many are ranked in parts; Spark then sorts the different strings of
   all parts by the pair of ranks of their two halves.

Ranks of positions in a task are exact; grams, contexts and halves are named by 64-bit hashes (a context
by two, a string of a large group by two). Only texts with shared anchors move, once or twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from seatwise.llm.common import in_sieve, sieve, stage

LENGTH = 200

#: Bytes of text that are ranked at once; positions of anchors fit into so many bits.
AT_ONCE_BITS = 18

#: Contexts of one gram that are ranked in one task; those of a gram with more are dealt out and meet string by string.
LARGE = 32

#: Places of the bitmaps that keep texts and anchors without partners out of the shuffles (8 and 4 MB).
GRAM_BITS, DOC_BITS = 26, 25

#: An odd factor of the rolling hash, and its inverse.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = (_powers(f, (1 << AT_ONCE_BITS) + 1) for f in (FACTOR, INVERSE))


# --- anchors -------------------------------------------------------------------------------------------

def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each position."""
    n = len(data)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[:n])))
    h = (sums[gram:] - sums[:-gram]) * _DOWN[:n - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(data: bytes, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, number, gram) of each anchor of the texts that end at ``ends`` in ``data``.

    ``first`` is where the first of ``number`` consecutive strings starts that have the anchor.
    """
    gram = max(1, length // 4)
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none
    h = gram_hashes(np.frombuffer(data, dtype=np.uint8), gram)
    low = np.uint64((1 << AT_ONCE_BITS) - 1)
    least, span, width = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1, length - gram + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:span - width], least[width - span:])
    at = (least & low).astype(np.int64)
    starts = np.arange(len(at))
    text = np.searchsorted(ends, starts, side="right")
    whole = starts + length <= ends[np.minimum(text, len(ends) - 1)]
    starts, at, text = starts[whole], at[whole], text[whole]
    if not len(starts):
        return none, none, none, none
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (text[1:] != text[:-1]))))
    return text[new], starts[new], np.diff(np.append(new, len(starts))), h[at[new]].view(np.int64)


def _stretches(texts: Iterable[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, list[tuple[int, int]]]]:
    """The texts, joined, at most 2 ** AT_ONCE_BITS bytes at once: (data, ends, (text, start in it) of each piece).

    Longer texts come in pieces that overlap by ``length`` - 1 bytes, so each string is in one of them.
    """
    most = 1 << AT_ONCE_BITS
    own, where, size = [], [], 0
    for n, text in enumerate(texts):
        at = 0
        while len(text) - at >= length:
            piece = text[at:at + most]
            if size + len(piece) > most:
                yield b"".join(own), np.cumsum([len(x) for x in own]), where
                own, where, size = [], [], 0
            own.append(piece)
            where.append((n, at))
            size += len(piece)
            at += len(piece) - length + 1
    if own:
        yield b"".join(own), np.cumsum([len(x) for x in own]), where


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, hash, text``: rows alike in id and hash are alike in text, and in every result."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select("doc_id", F.xxhash64(text).alias("hash"), text.alias("text"))


def _grams(docs: DataFrame, length: int) -> DataFrame:
    """``gram, n``: the grams of all anchors, counted in each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, ends, _ in _stretches((x.as_py() for x in batch.column(0)), length):
                gram, n = np.unique(anchors(data, ends, length)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n)], ["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram long, n long")


def _anchors(docs: DataFrame, bitmap: np.ndarray, length: int) -> DataFrame:
    """``doc_id, hash, gram, context, first, number`` of the anchors whose gram has its place in the bitmap."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    name = xxhash.xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, ends, where in _stretches((x.as_py() for x in batch.column(2)), length):
                piece, first, number, gram = anchors(data, ends, length)
                there = in_sieve(shared.value, gram, GRAM_BITS)
                piece, first, number, gram = piece[there], first[there], number[there], gram[there]
                context = np.fromiter((name(data[a:a + n + length - 1]) for a, n in zip(first.tolist(), number.tolist())),
                                      dtype=np.uint64, count=len(first))
                row, base = (np.array(x, dtype=np.int64) for x in zip(*where))
                begin = np.concatenate(([0], ends[:-1]))
                of = pa.array(row[piece])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(of), batch.column(1).take(of), pa.array(gram), pa.array(context.view(np.int64)),
                     pa.array((first - begin[piece] + base[piece]).astype(np.int32)), pa.array(number.astype(np.int32))],
                    ["doc_id", "hash", "gram", "context", "first", "number"])

    return docs.select("doc_id", "hash", "text").mapInArrow(run, f"doc_id {kind}, hash long, gram long, context long, first int, number int")


# --- prefix doubling -----------------------------------------------------------------------------------

def repeated_strings(texts: list[bytes], length: int) -> np.ndarray:
    """Which strings of ``length`` bytes occur more than once in the texts, by place in the joined texts; exactly.

    Ranks of the first bytes, then of pairs (own rank, rank one offset on) at offsets that double; places
    whose rank is unique drop out, and with them all that would need them.
    """
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))  # bytes of the own text from each place on
    out, size = np.zeros(len(data), dtype=bool), min(8, length)
    if len(data) < size:
        return out
    value = np.zeros(len(data) - size + 1, dtype=np.uint64)
    for k in range(size):
        value |= data[k:len(data) - size + 1 + k].astype(np.uint64) << np.uint64(8 * k)
    active = np.flatnonzero(left >= size)
    rank = np.full(len(data) + length, -1, dtype=np.int64)

    def ranked(where: np.ndarray, keys: np.ndarray) -> np.ndarray:
        _, of, n = np.unique(keys, return_inverse=True, return_counts=True)
        rank.fill(-1)
        again = n[of] > 1
        rank[where[again]] = of[again]
        return where[again]

    active = ranked(active, value[active])
    while size < length and len(active):
        offset = min(size, length - size)
        later = rank[active + offset]
        pair = (later >= 0) & (left[active] >= size + offset)
        active, later = active[pair], later[pair]
        size += offset
        active = ranked(active, rank[active] * (len(data) + 1) + later)
    out[active] = True
    return out


def _spans(flags: np.ndarray, length: int) -> list[tuple[int, int]]:
    """[start, end) of the bytes that strings starting at the flagged places cover."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    gap = np.flatnonzero(np.diff(at) > length)
    return list(zip(at[np.concatenate(([0], gap + 1))].tolist(), (at[np.concatenate((gap, [len(at) - 1]))] + length).tolist()))


#: Bytes of contexts that are ranked at once in a task.
CONTEXT_BYTES = 1 << 19

#: Rows that a task hands on at once.
ROWS_AT_ONCE = 50_000

SPAN = "struct<start: int, end: int>"


def _chunk() -> Column:
    """Which part of a gram's contexts a context belongs to; a part holds about ``LARGE`` of them."""
    parts = F.ceil(F.col("kinds") / LARGE)
    return F.when(parts > 1, F.pmod(F.xxhash64("context"), parts)).otherwise(F.lit(0).cast("long"))


def _ranked_parts(contexts: DataFrame, length: int) -> DataFrame:
    """``doc_id, hash, start, end, left, right``: a gram's contexts are ranked in parts of about ``LARGE``.

    Rows without ``left`` are repeated spans of contexts that stand once. Where a gram has several parts, each
    part also tells its strings to the others: one row for each different one, named by the ranks of its
    halves, with ``start`` where it stands if it is not known to be repeated, else null.
    """
    kind = contexts.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "hash", "start", "end", "left", "right"]
    types = [to_arrow_type(contexts.schema["doc_id"].dataType), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    half, name, large = length // 2, xxhash.xxh64_intdigest, LARGE

    def signed(x: int) -> int:
        return x if x < 1 << 63 else x - (1 << 64)

    def made(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def resolved(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        own = list({(r["gram"], r["context"]): r for r in rows}.values())  # one that stands twice may come from equal rows
        flags = repeated_strings([r["bytes"] for r in own], length)
        out, told, at = [], set(), 0
        for r in own:
            data, once = r["bytes"], r["copies"] == 1
            again = flags[at:at + len(data)]
            at += len(data)
            if once:
                out += [(r["doc_id"], r["hash"], r["first"] + a, r["first"] + b, None, None) for a, b in _spans(again, length)]
            if r["kinds"] <= large:
                continue
            for i in range(len(data) - length + 1):
                key = (signed(name(data[i:i + half], 1)), signed(name(data[i + half:i + length], 2)))
                if not again[i] or key not in told:
                    told.add(key)
                    out.append((r["doc_id"], r["hash"], r["first"] + i if once and not again[i] else None, None, *key))
            if len(out) >= ROWS_AT_ONCE:
                yield made(out)
                out = []
        yield made(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if size >= CONTEXT_BYTES and (r["gram"], r["part"]) != (rows[-1]["gram"], rows[-1]["part"]):
                    yield from resolved(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r["bytes"])
        if rows:
            yield from resolved(rows)

    dealt = contexts.withColumn("part", _chunk()).repartition("gram", "part").sortWithinPartitions("gram", "part")
    return dealt.mapInArrow(run, f"doc_id {kind}, hash long, start int, end int, left long, right long")


def _repeated(contexts: DataFrame, length: int) -> DataFrame:
    """``doc_id, hash, start, end``: the repeated parts of open contexts that stand once."""
    rows = stage(_ranked_parts(contexts, length), "ranked")
    spans = rows.filter("left IS NULL").select("doc_id", "hash", "start", "end")
    told = rows.filter("left IS NOT NULL")
    again = told.groupBy("left", "right").agg(F.count("*").alias("n")).filter("n > 1").select("left", "right")
    late = told.filter("start IS NOT NULL").join(again, ["left", "right"], "left_semi")
    return spans.unionByName(late.select("doc_id", "hash", "start", (F.col("start") + length).alias("end")))


# --- documents -----------------------------------------------------------------------------------------

def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the spans cover."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


def _result(text: bytes, spans: list[tuple[int, int]], digest: bool) -> dict:
    runs = merged(spans)
    rest = without(text, runs)
    return {"n_bytes": len(text), "spans": [{"start": a, "end": b} for a, b in runs],
            "kept": hashlib.sha256(rest).hexdigest() if digest else rest}


def _probed(docs: DataFrame, bitmap: np.ndarray, digest: bool) -> DataFrame:
    """All rows; those whose place the bitmap lacks share no anchor, and come with their result instead of their text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = in_sieve(shared.value, batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64), DOC_BITS)
            made = [None if t else _result(x.as_py(), [], digest) for t, x in zip(there.tolist(), batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pc.if_else(pa.array(there), batch.column(2), pa.scalar(None, batch.column(2).type)).cast(pa.binary()),
                 pa.array([m and m["n_bytes"] for m in made], pa.int64()),
                 pa.array([m and m["kept"] for m in made], pa.string() if digest else pa.binary())],
                ["doc_id", "hash", "text", "n_bytes", "kept"])

    own = docs.select("doc_id", "hash", "text", _doc_key().alias("key"))
    return own.mapInArrow(run, f"doc_id {kind}, hash long, text binary, n_bytes long, kept {'string' if digest else 'binary'}")


def _doc_key() -> Column:
    return F.xxhash64("doc_id", "hash")


def _with(rows: DataFrame, more: DataFrame) -> DataFrame:
    """Left join on id and hash, null ids equal."""
    more = more.select(F.col("doc_id").alias("_i"), F.col("hash").alias("_h"), *[c for c in more.columns if c not in ("doc_id", "hash")])
    return rows.join(more, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("hash") == F.col("_h")), "left").drop("_i", "_h")


def _settled(rows: DataFrame, digest: bool) -> DataFrame:
    """Results of the rows that have no open context; the others keep their text."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    open_kind = rows.schema["open"].dataType.simpleString() if "open" in rows.columns else None
    names = ["doc_id", "hash", "n_bytes", "spans", "kept"] + (["text", "known", "open"] if open_kind else [])
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {c: batch.column(c) for c in batch.schema.names}
            made, waiting = [], []
            for k, text in enumerate(column["text"]):
                waiting.append(bool(open_kind and column["open"][k].is_valid and len(column["open"][k])))
                if waiting[-1]:
                    made.append({"n_bytes": None, "spans": None, "kept": None})
                elif text.as_py() is None:
                    made.append({"n_bytes": column["n_bytes"][k].as_py(), "spans": [], "kept": column["kept"][k].as_py()})
                else:
                    spans = [(s["start"], s["end"]) for c in ("known", "found") if c in column for s in column[c][k].as_py() or ()]
                    made.append(_result(text.as_py(), spans, digest))
            out = [column["doc_id"], column["hash"], pa.array([m["n_bytes"] for m in made], pa.int64()),
                   pa.array([m["spans"] for m in made], span),
                   pa.array([m["kept"] for m in made], pa.string() if digest else pa.binary())]
            yield pa.RecordBatch.from_arrays(
                out + ([pc.if_else(pa.array(waiting, pa.bool_()), column["text"], pa.scalar(None, column["text"].type)).cast(pa.binary()),
                        column["known"], column["open"]] if open_kind else []), names)

    schema = f"doc_id {kind}, hash long, n_bytes long, spans array<{SPAN}>, kept {'string' if digest else 'binary'}"
    return rows.mapInArrow(run, schema + (f", text binary, known array<{SPAN}>, open {open_kind}" if open_kind else ""))


def remove_repeats(docs: DataFrame, length: int = LENGTH, digest: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, spans, kept``.

    ``spans`` are the maximal runs of bytes, [start, end), that strings of ``length`` bytes cover which also
    start anywhere else in the table, in the same text or another; ``kept`` is what is left of the text in
    UTF-8 (with ``digest``, its lower-case SHA-256). Strings are judged on the input and never cross texts.
    Null texts are empty; rows that repeat an id, or a whole row, are documents of their own; null ids are
    kept. An empty table gives an empty result; other columns of ``docs`` play no part.
    """
    docs = _keyed(docs)
    common = stage(_grams(docs, length).groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1").select("gram"), "grams")
    bitmap = sieve(common, F.col("gram"), GRAM_BITS)
    shared = stage(_anchors(docs, bitmap, length).join(common, "gram"), "anchors")
    contexts = shared.groupBy("gram", "context").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", "hash", "first")).alias("place"), F.max("number").alias("number"))
    contexts = stage(contexts, "contexts")
    kinds = contexts.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    known = shared.join(contexts.filter("copies > 1").select("gram", "context"), ["gram", "context"], "left_semi").select(
        "doc_id", "hash", F.struct(F.col("first").alias("start"), (F.col("first") + F.col("number") + (length - 1)).alias("end")).alias("known"),
        F.lit(None).cast("struct<first: int, number: int, gram: bigint, context: bigint, copies: bigint, kinds: bigint>").alias("open"))
    open_ = contexts.join(kinds, "gram").select(
        "place.doc_id", "place.hash", F.lit(None).cast(SPAN).alias("known"),
        F.struct("place.first", "number", "gram", "context", "copies", "kinds").alias("open"))
    marks = stage(known.unionByName(open_).groupBy("doc_id", "hash").agg(
        F.collect_list("known").alias("known"), F.collect_list("open").alias("open")), "marks")  # as many as a text has anchors at most
    places = sieve(marks, _doc_key(), DOC_BITS)
    rows = stage(_settled(_with(_probed(docs, places, digest), marks), digest), "settled")

    waiting = rows.filter("text IS NOT NULL")
    each = waiting.select("doc_id", "hash", "text", F.explode("open").alias("o"))
    bytes_ = F.substring("text", F.col("o.first") + 1, F.col("o.number") + (length - 1))
    each = each.select("doc_id", "hash", "o.gram", "o.context", "o.first", "o.copies", "o.kinds", bytes_.alias("bytes"))
    found = _repeated(each, length).groupBy("doc_id", "hash").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    last = _settled(_with(waiting.select("doc_id", "hash", "text", "known"), found), digest)
    return rows.filter("text IS NULL").select("doc_id", "n_bytes", "spans", "kept").unionByName(
        last.select("doc_id", "n_bytes", "spans", "kept"))


def _oracle(length: int) -> str:
    two = 2 * length
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT k, unnest(range(0, greatest(0, n - {length - 1}))) AS i FROM d),
s AS (SELECT w.k, w.i, md5_number(substr(d.x, CAST(2 * w.i + 1 AS BIGINT), {two})) AS h FROM w JOIN d USING (k)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY h) AS c FROM s) WHERE c > 1),
g AS (SELECT k, i, sum(new) OVER (PARTITION BY k ORDER BY i) AS run FROM (
  SELECT k, i, CASE WHEN i - lag(i) OVER (PARTITION BY k ORDER BY i) <= {length} THEN 0 ELSE 1 END AS new FROM r)),
p AS (SELECT k, run, min(i) AS a, max(i) + {length} AS b FROM g GROUP BY k, run),
q AS (SELECT k, sum(b - a) AS n_removed, count(*) AS n_spans FROM p GROUP BY k),
kept AS (
  SELECT k, string_agg(substr(d.x, CAST(2 * f + 1 AS BIGINT), CAST(2 * (t - f) AS BIGINT)), '' ORDER BY f) AS x FROM (
    SELECT k, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS f, a AS t FROM p
    UNION ALL SELECT d.k, coalesce(max(p.b), 0), any_value(d.n) FROM d LEFT JOIN p ON p.k = d.k GROUP BY d.k) JOIN d USING (k)
  GROUP BY k)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(q.n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(q.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.x)) AS kept_sha256
FROM d LEFT JOIN q USING (k) LEFT JOIN kept USING (k)
"""


ORACLE_SQL = _oracle(LENGTH)
