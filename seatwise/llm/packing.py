"""Best-fit packing by linear grouping.

Documents become token pieces of at most one sequence. Where a piece goes depends only on its length and
its rank among the pieces of that length, so the plan is made from the count of each length alone (as
many counts as a sequence has tokens, however large the corpus): long lengths are dealt by rank into
groups of equal size and rounded up to the longest of their group; the linear programme over
configurations of these few sizes, solved by column generation, says how many sequences use each
configuration; the slots of each are filled with the groups' actual lengths; short lengths then go
where they fit best, longest first. Ranks are counted in salted parts of each length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seatwise.llm.common import row_ids, stage

CAPACITY = 2048
END = 0
GROUPS = 64
SMALL = 8

#: The linear programme stops within this part of its optimum, or after so many rounds.
GAP = 2e-4
ROUNDS = 1000
PART_ROWS = 50_000

#: How byte-level BPE cuts a text before merging; a fixed value of the format.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

#: tiktoken's backtracking fails on runs of white space from somewhere below 700,000 characters.
SAFE_RUN = 100_000
LONG_SPACE = re.compile(r"\s{64,}")

_ENCODERS: dict[str, Encoder] = {}


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Encoder:
    """Token ids, as little-endian unsigned 32-bit numbers, that ``tokenizers`` gives for a tokenizer file.

    Where the file is plain byte-level BPE whose ids are in merge order, ranks are all that defines it, and
    tiktoken merges by the same ranks faster; other files, and texts that hold a special token or a run of
    white space of more than ``SAFE_RUN`` characters, go through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = self._ranked(path)

    @staticmethod
    def _ranked(path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, cut_by = file["model"], file.get("pre_tokenizer") or {}
        plain = (model["type"] == "BPE" and not file.get("normalizer") and not file.get("post_processor")
                 and cut_by.get("type") == "ByteLevel" and cut_by.get("use_regex", True) and not cut_by.get("add_prefix_space")
                 and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix")))
        if not plain:
            return None
        vocab = model["vocab"]
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(merged):
            return None
        import tiktoken
        byte = _byte_letters()
        ranks = {bytes(byte[c] for c in token): n for token, n in vocab.items()}
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _by_rank(self, text: str) -> bool:
        return (self.ranked is not None and not any(s in text for s in self.special)
                and (len(text) <= SAFE_RUN or all(m.end() - m.start() <= SAFE_RUN for m in LONG_SPACE.finditer(text))))

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if self._by_rank(text):
                ids = self.ranked.encode_ordinary(text)
            else:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            out.append(np.array(ids, dtype="<u4").tobytes())
        return out


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, the rest in the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False,
           id_col: str = "doc_id", text_col: str = "text", texts_at_once: int = 256) -> DataFrame:
    """``doc_id, row, piece, start, length, ids_crc32`` and, if asked, the ``ids`` as bytes."""
    path = tokenizer or default_tokenizer()
    rows = row_ids(docs.select(F.col(id_col).alias("doc_id"),
                               F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), "row")
    names = ["doc_id", "row", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    end = np.array([END], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, texts_at_once):
                part = batch.slice(at, texts_at_once)
                source, out = [], [[] for _ in names[2:]]
                for k, ids in enumerate(encode(part.column(1).to_pylist())):
                    ids += end
                    for n, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        own = ids[4 * start:4 * (start + length)]
                        source.append(k)
                        for column, value in zip(out, (n, start, length, zlib.crc32(own), own)):
                            column.append(value)
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                index = pa.array(source, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(index), part.column(2).take(index),
                     *[pa.array(c, t) for c, t in zip(out, types)]], names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "row").mapInArrow(
        run, f"doc_id {kind}, row long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


# --- the plan, from the counts of lengths -------------------------------------------------------------

def _best_configuration(sizes: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """The multiset of sizes of most value that fits: a knapsack, size after size."""
    best, taken = np.zeros(capacity + 1), []
    for size, worth in zip(sizes.tolist(), value.tolist()):
        without, n = best.copy(), np.zeros(capacity + 1, dtype=np.int8)
        for j in range(1, capacity // size + 1 if worth > 0 else 0):
            gain = without[:capacity + 1 - j * size] + j * worth
            better = gain > best[j * size:] + 1e-12
            np.copyto(best[j * size:], gain, where=better)
            n[j * size:][better] = j
        taken.append(n)
    out, c = np.zeros(len(sizes), dtype=np.int64), capacity
    for k in range(len(sizes) - 1, -1, -1):
        out[k] = taken[k][c]
        c -= int(out[k]) * int(sizes[k])
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """Few configurations of the sizes, with how often each is used; their slots cover the demand."""
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.linalg.inv(basis)
    level = inverse @ demand
    for _ in range(rounds):
        price = inverse.sum(axis=0)
        column = _best_configuration(sizes, np.maximum(price, 0), capacity).astype(float)
        if price @ column <= 1 + GAP:
            break
        change = inverse @ column
        ratio = np.where(change > 1e-9, level / np.where(change > 1e-9, change, 1), np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        basis[:, leave] = column
        pivot = inverse[leave] / change[leave]
        inverse -= np.outer(change, pivot)
        inverse[leave] = pivot
        level = np.maximum(inverse @ demand, 0)
    out, left = [], demand.astype(np.int64).copy()
    for k in np.argsort(-level):
        config = basis[:, k].round().astype(np.int64)
        n = int(level[k] + 1e-6)
        if n:
            out.append((config, n))
            left = np.maximum(left - config * n, 0)
    while left.any():  # what rounding down left over: full as can be, one sequence after another
        config, room = np.zeros(m, dtype=np.int64), capacity
        for k in np.argsort(-sizes):
            config[k] = min(int(left[k]), room // int(sizes[k]))
            room -= int(config[k] * sizes[k])
        n = int(min(left[k] // config[k] for k in range(m) if config[k]))
        out.append((config, n))
        left -= config * n
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> np.ndarray:
    """Rows (length, first rank, end rank, first sequence, offset): rank r goes to sequence first + r - first rank."""
    rows: list[tuple[int, int, int, int, int]] = []
    used = dict.fromkeys(counts, 0)
    bins = 0

    def place(length: int, n: int, at: int, offset: int) -> None:
        rows.append((length, used[length], used[length] + n, at, offset))
        used[length] += n

    if counts.get(capacity):
        place(capacity, counts[capacity], 0, 0)
        bins = counts[capacity]
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> ranges (first sequence, how many)
    large = sorted((x for x in counts if capacity > x > capacity // small and counts[x]), reverse=True)
    if large:
        total = sum(counts[x] for x in large)
        per = -(-total // groups)
        size, members, k, filled = [], [], -1, per
        for x in large:
            n = counts[x]
            while n:
                if filled == per:
                    size.append(x)
                    members.append([])
                    k, filled = k + 1, 0
                m = min(n, per - filled)
                members[k].append([x, m])
                filled, n = filled + m, n - m
        merged: dict[int, list[list[int]]] = {}
        for x, own in zip(size, members):
            merged.setdefault(x, []).extend(own)
        sizes = np.array(list(merged), dtype=np.int64)
        queues = [merged[int(x)][::-1] for x in sizes]
        demand = np.array([sum(n for _, n in q) for q in queues], dtype=np.int64)
        for config, n in configurations(sizes, demand, capacity):
            slots = [k for k in range(len(sizes)) for _ in range(int(config[k]))]
            while n:
                # As many sequences alike as the groups' next lengths allow.
                need = {k: int(config[k]) for k in set(slots)}
                have = {k: q for k in need if (q := queues[k])}
                if not have:
                    break
                same = min([n, *(max(1, have[k][-1][1] // need[k]) for k in have)])
                offset = 0
                for k in sorted(have, key=lambda k: -sizes[k]):
                    for _ in range(need[k]):
                        if queues[k]:
                            x = queues[k][-1][0]
                            place(x, same, bins, offset)
                            queues[k][-1][1] -= same
                            if not queues[k][-1][1]:
                                queues[k].pop()
                            offset += x
                open_[capacity - offset].append((bins, same))
                bins, n = bins + same, n - same
    rooms = sorted(open_)
    for x in sorted((x for x in counts if x <= capacity // small and counts[x]), reverse=True):
        n = counts[x]
        while n:
            k = bisect_left(rooms, x)
            if k == len(rooms):
                per = capacity // x
                many = max(1, n // per)
                first, m, room = bins, many, capacity
                bins += many
            else:
                room = rooms[k]
                first, m = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[k]
            each = min(room // x, n)
            alike = min(m, n // each)
            for j in range(each):
                place(x, alike, first, capacity - room + j * x)
            n -= each * alike
            for left, at, many in ((room - each * x, first, alike), (room, first + alike, m - alike)):
                if many and left:
                    if left not in open_:
                        insort(rooms, left)
                    open_[left].append((at, many))
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, groups: int = GROUPS,
         keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``).

    Null and empty texts are documents of the end id alone. Repeated rows are documents of their own, so a
    (doc_id, piece) may repeat; null ids are kept. Lengths that tie are placed in the order of salt, id
    and row. An empty table gives an empty result; other columns play no part.
    """
    rows = stage(pieces(docs, tokenizer, capacity, keep_ids, id_col, text_col), "pieces", "zstd")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = plan(counts, capacity, groups)
    parts = max(16, max(counts.values(), default=0) // PART_ROWS)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row", "piece"), F.lit(parts)))
    starts = (rows.groupBy("length", "part").agg(F.count("*").alias("n"))
              .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
              .select("length", "part", "before"))
    here = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "row", "piece"))
    ranked = rows.withColumn("rank", here).join(starts, ["length", "part"]).withColumn(
        "rank", F.col("before") + F.col("rank") - 1).drop("before", "part")
    shift = int(max(table[:, 2].max(initial=0), 1)).bit_length()
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    keys = (table[:, 0] << shift) + table[:, 1]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            at = np.searchsorted(keys, (length << shift) + rank, side="right") - 1
            own = dict(zip(batch.schema.names, batch.columns)) | {
                "sequence_id": pa.array(table[at, 3] + rank - table[at, 1]), "offset": pa.array(table[at, 4])}
            yield pa.RecordBatch.from_arrays([own[n] for n in names], names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, "
                                  "offset long" + ", ids binary" * keep_ids)
