"""Language-model scores by a weighted backoff automaton.

The model is a word n-gram model with Dirichlet smoothing. As an automaton, each context seen in training
is a state; reading a token either follows the arc of a seen n-gram, of weight (count + m * lower) /
(context + m), or takes the state's failure arc, of weight m / (context + m), to the state of the shorter
context; a state that training never saw fails with weight 1. The root gives discounted unigrams and one
share for all unknown words. Texts are read once from left to right, carrying the state.

The whole model fits no task, so texts are held in blocks of a bounded number of tokens and a block builds
the part of the automaton that its texts can reach. Each block sends its distinct n-grams with their
training counts to shards; a shard adds up what all blocks sent and answers each with the totals. What
moves is packed: sorted n-gram numbers, counts and words, each compressed. Words are compared as
themselves; n-grams of two words or more by a 64-bit hash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatwise.llm.common import stage

ORDER = 3
BLOCK_TOKENS = 1 << 21
SHARD_TOKENS = 1 << 19

#: The smoothing weights tried; the one under which training texts, each token left out in turn, are likeliest is used.
WEIGHTS = (0.5, 2.0, 8.0, 32.0, 128.0, 512.0, 2048.0, 8192.0, 65536.0)

END = b""


def _squeeze(values: np.ndarray) -> bytes:
    """Compressed by bytes of equal rank: high bytes of small numbers vanish."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unsqueeze(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def _squeeze_sorted(keys: np.ndarray) -> bytes:
    return _squeeze(np.diff(keys, prepend=np.uint64(0)))


def _unsqueeze_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unsqueeze(data, np.uint64), dtype=np.uint64)


def _mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit hash of a pair of hashes (the constants are two odd multipliers)."""
    x = left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29)))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Numbers(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words, then the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def _blocks(docs: DataFrame, block_tokens: int) -> DataFrame:
    """Texts as word numbers: a row holds documents of about ``block_tokens`` tokens, and their words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        number, texts, ids, held, size = _Numbers({END: 0}), [], [], [], 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(t) for t in texts], dtype=np.int32)
            words = b" ".join(list(number)[1:])
            row = [pa.array([part * (1 << 32) + n]), pa.array([ids], pa.list_(kind_of)), pa.array([held], pa.list_(pa.bool_())),
                   pa.array([lengths.tolist()], pa.list_(pa.int32())), pa.array([int(lengths.sum(dtype=np.int64))]),
                   pa.array([_squeeze(np.concatenate(texts))], pa.binary()),
                   pa.array([zstandard.ZstdCompressor(level=1).compress(words)], pa.binary())]
            return pa.RecordBatch.from_arrays(row, ["block", "doc_ids", "held", "lengths", "n", "ids", "words"])

        for batch in batches:
            kind_of = batch.schema.field(0).type
            rows = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_pylist()
            for doc, text, out in zip(*rows):
                words = tokens(text)
                t = np.fromiter(map(number.__getitem__, words), dtype=np.uint32, count=len(words))
                texts.append(t)
                ids.append(doc)
                held.append(out)
                size += len(t)
                if size >= block_tokens:
                    yield flush()
                    n += 1
                    number, texts, ids, held, size = _Numbers({END: 0}), [], [], [], 0
        if texts:
            yield flush()

    return docs.mapInArrow(run, f"block long, doc_ids array<{kind}>, held array<boolean>, lengths array<int>, n long, "
                                "ids binary, words binary")


class _Block:
    """One block opened: word hashes, and the n-gram number at each token for each order."""

    def __init__(self, lengths: np.ndarray, held: np.ndarray, ids: bytes, words: bytes):
        text = zstandard.ZstdDecompressor().decompress(words)
        self.words = [END, *(text.split(b" ") if text else [])]
        self.hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in self.words], dtype=np.uint64)
        self.ids = _unsqueeze(ids, np.uint32)
        self.lengths = np.asarray(lengths, dtype=np.int64)
        self.learnt = np.repeat(~np.asarray(held, dtype=bool), self.lengths)
        self.first = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.order = np.argsort(self.hashes, kind="stable")

    def before(self, k: int) -> np.ndarray:
        """The word k tokens before each token; before a text stand ends."""
        out = np.zeros_like(self.ids)
        out[k:] = self.ids[:-k]
        for j in range(1, k):
            at = self.first + j
            out[self.first[self.lengths > j - 1]] = 0
            out[at[self.lengths > j]] = 0
        out[self.first] = 0
        return out

    def numbers(self, order: int) -> np.ndarray:
        x = self.hashes[self.before(order - 1)]
        for k in range(order - 2, -1, -1):
            x = _mix(x, self.hashes[self.before(k) if k else self.ids])
        return x


def _sent(blocks: DataFrame, order: int, bits: int) -> DataFrame:
    """For each block and shard: its words and n-grams there, with their counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - bits)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                b = _Block(row["lengths"], row["held"], row["ids"], row["words"])
                out = defaultdict(lambda: [None] * (2 * order))
                edges = np.arange(1, 1 << bits, dtype=np.uint64) << shift
                counts = np.bincount(b.ids, weights=b.learnt, minlength=len(b.words)).astype(np.uint32)[b.order]
                for k in range(order):
                    if k:
                        keys, inverse = np.unique(b.numbers(k + 1), return_inverse=True)
                        counts = np.bincount(inverse, weights=b.learnt, minlength=len(keys)).astype(np.uint32)
                    else:
                        keys = b.hashes[b.order]
                    cut = np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))
                    for s in np.flatnonzero(np.diff(cut)).tolist():
                        own = slice(cut[s], cut[s + 1])
                        out[s][2 * k] = _squeeze_sorted(keys[own]) if k else zstandard.ZstdCompressor(level=1).compress(
                            b" ".join([b.words[i] for i in b.order[own].tolist()]))
                        out[s][2 * k + 1] = _squeeze(counts[own])
                shards = sorted(out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards, pa.int32()), pa.array([row["block"]] * len(shards), pa.int64()),
                     *[pa.array([out[s][c] for s in shards], pa.binary()) for c in range(2 * order)]],
                    ["shard", "block", *[f"{c}{k}" for k in range(order) for c in "kc"]])

    return blocks.mapInArrow(run, "shard int, block long, " + ", ".join(f"k{k} binary, c{k} binary" for k in range(order)))


def _answered(sent: DataFrame, order: int) -> DataFrame:
    """For each block and shard the totals of what it sent, in its order; block -1 has the shard's word statistics."""
    names = [f"t{k}" for k in range(order)]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block", ignore_index=True)
        out = {"shard": rows["shard"], "block": rows["block"], **{n: [None] * len(rows) for n in names}}
        stats = [0, 0, 0, 0]
        for k in range(order):
            has = [i for i, x in enumerate(rows[f"c{k}"]) if x is not None]
            if not has:
                continue
            counts = [_unsqueeze(rows[f"c{k}"][i], np.uint32) for i in has]
            if k:
                _, number = np.unique(np.concatenate([_unsqueeze_sorted(rows[f"k{k}"][i]) for i in has]), return_inverse=True)
            else:
                known = _Numbers()
                opened = (zstandard.ZstdDecompressor().decompress(rows["k0"][i]).split(b" ") for i in has)
                number = np.concatenate([[known[w] for w in words] for words in opened])
            total = np.bincount(number, weights=np.concatenate(counts)).astype(np.int64)
            if not k:
                stats = [int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum())]
            at = 0
            for i, c in zip(has, counts):
                out[names[k]][i] = _squeeze(total[number[at:at + len(c)]])
                at += len(c)
        frame = pd.DataFrame(out)
        for c, v in zip(("n", "v", "n1", "n2"), stats):
            frame[c] = 0
        frame.loc[len(frame)] = [key[0], -1, *[None] * order, *stats]
        return frame

    return sent.groupBy("shard").applyInPandas(
        run, "shard int, block long, " + ", ".join(f"{n} binary" for n in names) + ", n long, v long, n1 long, n2 long")


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, by key, and the number of each key among them."""
    by = np.argsort(keys)
    keys = keys[by]
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    number = np.empty(len(by), dtype=np.int32)
    number[by] = np.cumsum(new, dtype=np.int32) - 1
    return by[new].astype(np.int32), number


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """One array; the parts go at once."""
    out = np.concatenate(parts)
    parts.clear()
    return out


class Automaton:
    """The part of the automaton that a block's texts can reach.

    States are the root (0), then the contexts of one word, of two, and so on, as the block numbers them. An
    arc leaves a state on a word for each n-gram that training holds; the root has an arc for every word, and
    these come first. ``failure`` leads to the state of the context without its first word. ``reach`` finds
    arcs: out of a state of d words, which are those before a token, its word's arc is that of the n-gram of
    d + 1 words that ends there, or -1.
    """

    def __init__(self, block: _Block, totals: list[np.ndarray], order: int):
        words, ids = len(block.words), block.ids.astype(np.int32)
        self.words, self.order = words, order
        seen = np.empty(words, dtype=np.int64)
        seen[block.order] = totals[0]
        root = np.arange(words, dtype=np.int32)
        self.reach = np.empty((order, len(ids)), dtype=np.int32)
        self.reach[0] = ids
        size, failure = [np.zeros(1, dtype=np.int64), seen], [np.zeros(1 + words, dtype=np.int32)]
        count, after = [seen], [np.where((seen > 0) & (order > 1), 1 + root, np.int32(0))]
        none = np.zeros(0, dtype=np.int32)
        state, lower, length = [none], [none], [none.astype(np.int8)]
        self.spans = []  # of the arcs of each length, from two words on
        base, states, arcs = 1, 1 + words, words  # the first state of the contexts one word shorter; states and arcs so far
        shorter = None  # each token's number among the contexts one word shorter
        for k in range(2, order + 1):
            at, number = _numbered(block.numbers(k))
            total = totals[k - 1]
            there = total > 0
            if k == 2:
                source, suffix = 1 + block.before(1)[at].astype(np.int32), 1 + ids[at]
            else:  # at the start of a text no context of two words has been read
                starts = np.zeros(len(ids), dtype=bool)
                starts[block.first] = True
                there &= ~starts[at]
                source, suffix = base + shorter[np.maximum(at - 1, 0)], base + shorter[at]
            n = int(there.sum())
            below = self.reach[k - 2][at[there]]
            place = np.full(len(total), -1, dtype=np.int32)
            place[there] = np.arange(arcs, arcs + n, dtype=np.int32)
            self.reach[k - 1] = place[number]
            if k < order:
                size.append(total)
                failure.append(suffix)
                suffix = np.arange(states, states + len(total), dtype=np.int32)
                base, shorter = states, number
                states += len(total)
            state.append(source[there])
            count.append(total[there])
            after.append(suffix[there])
            lower.append(np.where(below >= 0, below, ids[at[there]]))
            length.append(np.full(n, k, dtype=np.int8))
            self.spans.append((arcs, arcs + n))
            arcs += n
        self.depth = np.concatenate([np.full(len(x), d, dtype=np.int8) for d, x in enumerate(size)])
        self.size, self.failure, self.counts, self.after = map(_joined, (size, failure, count, after))
        #: Of the arcs of two words and more: the state they leave, the arc of their word out of the state that it fails to, their words.
        self.state, self.lower, self.length = map(_joined, (state, lower, length))
        self.start = 1 if order > 1 and seen[0] > 0 else 0

    def read(self, block: _Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The state before each token, how many failure arcs are taken there, and the arc that is followed.

        All texts are read at once from left to right, a token of each at a time, carrying their states.
        """
        n = len(block.ids)
        states, fails, arcs = np.empty(n, dtype=np.int32), np.zeros(n, dtype=np.int8), np.empty(n, dtype=np.int32)
        by = np.argsort(-block.lengths, kind="stable")
        first, lengths = block.first[by], block.lengths[by]
        state = np.full(len(by), self.start, dtype=np.int32)
        going = np.searchsorted(-lengths, -np.arange(int(lengths.max(initial=0))), side="left").tolist()
        for step, texts in enumerate(going):
            at = first[:texts] + step
            here = state[:texts]
            states[at] = here
            taken = self.reach[self.depth[here], at]
            left = np.flatnonzero(taken < 0)
            if len(left):
                here = here.copy()
            while len(left):
                fails[at[left]] += 1
                here[left] = to = self.failure[here[left]]
                taken[left] = found = self.reach[self.depth[to], at[left]]
                left = left[found < 0]
            arcs[at] = taken
            state[:texts] = self.after[taken]
        return states, fails, arcs


def _scored(blocks: DataFrame, answers: DataFrame, order: int, stats: tuple[int, int, int, int], weights: tuple[float, ...],
            kind: str) -> DataFrame:
    n, v, n1, n2 = stats
    discount = n1 / (n1 + 2 * n2 + 1)

    def root(c: np.ndarray) -> np.ndarray:
        """Probability of words seen c times; the unknown share the discounted mass."""
        if not n:
            return np.ones(len(c))
        return np.where(c > 0, np.maximum(c - discount, 1e-9), max(discount * v, 1.0)) / n

    def run(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "scores", "left_out"]
        if not len(own):
            return pd.DataFrame(columns=names)
        told = told.sort_values("shard")
        row = own.iloc[0]
        b = _Block(row["lengths"], row["held"], row["ids"], row["words"])
        a = Automaton(b, [np.concatenate([_unsqueeze(x, np.int64) for x in told[f"t{k}"] if x is not None] or [np.zeros(0, np.int64)])
                          for k in range(order)], order)
        states, fails, arcs = a.read(b)
        del a.reach, a.after
        seen = a.counts[:a.words]
        context = a.size[a.state]
        rounds, at = [], np.flatnonzero(fails)  # the tokens that fail once, twice and so on, and what their states have been seen
        here, left = states[at], fails[at]
        while len(at):
            rounds.append((at, a.size[here]))
            left -= 1
            at, here, left = at[left > 0], a.failure[here[left > 0]], left[left > 0]
        learnt = np.bincount(arcs[b.learnt], minlength=len(a.counts)).astype(np.float64)
        del states, fails, a.state, a.failure
        total = lambda x: np.add.reduceat(x, b.first)

        def weighed(m: float, less: int) -> np.ndarray:
            """The log10 probability of each arc; with ``less`` as if one of its n-grams had not been seen."""
            p = np.empty(len(a.counts))
            p[:a.words] = root(seen - less)
            for start, end in a.spans:  # arcs of longer n-grams weigh in those of shorter ones
                own = slice(start - a.words, end - a.words)
                size, below = context[own], p[a.lower[own]]
                p[start:end] = (a.counts[start:end] - less + m * below) / (np.maximum(size - less, 0) + m)
                if less:
                    alone = np.flatnonzero(size <= 1)
                    p[start + alone] = below[alone]
            return np.log10(p, out=p)

        scores, left_out = [], []
        for m in weights:
            log = weighed(m, 0)[arcs]
            for at, size in rounds:
                log[at] += np.log10(m / (size + m))
            scores.append(total(log))
            del log
            log = weighed(m, 1)
            log *= learnt
            left_out.append(float(log.sum()))
            del log
        count = seen[b.ids]
        return pd.DataFrame(dict(zip(names, [
            list(row["doc_ids"]), list(row["held"]), b.lengths, total((count > 0).astype(np.int64)),
            total(np.log10((count + 1) / (n + v + 1))), list(np.stack(scores, axis=1)),
            [left_out] + [None] * (len(b.lengths) - 1)])))

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, scores array<double>, "
             "left_out array<double>")


def score(docs: DataFrame, held_out: str = "pmod(crc32(cast(doc_id as string)), 7) = 2", order: int = ORDER,
          weights: tuple[float, ...] = WEIGHTS, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The model learns from documents for which ``held_out`` (an expression over ``doc_id``) isn't true, null
    included. Null and empty texts are the end alone. Repeated rows are learnt and scored one by one. With
    nothing to learn from, all words are unknown. An empty table gives an empty result; other columns
    play no part.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.select("doc_id", "text", F.coalesce(F.expr(held_out), F.lit(False)).alias("held"))
    blocks = stage(_blocks(rows, block_tokens), "blocks")
    size = blocks.agg(F.sum("n")).first()[0] or 0
    bits = max(3, int(size // shard_tokens).bit_length())
    answers = stage(_answered(_sent(blocks, order, bits), order), "answers")
    stats = tuple(x or 0 for x in answers.filter("block = -1").agg(*[F.sum(c) for c in ("n", "v", "n1", "n2")]).first())
    told = answers.filter("block >= 0").select("block", "shard", *[f"t{k}" for k in range(order)])
    found = stage(_scored(blocks, told, order, stats, weights, kind), "scores")
    likely = found.agg(*[F.sum(F.element_at("left_out", k + 1)) for k in range(len(weights))]).first()
    best = max(range(len(weights)), key=lambda k: (likely[k] if likely[k] is not None else float("-inf"), -k))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(stats[0]).cast("long").alias("train_tokens"),
                        "base_score", F.element_at("scores", best + 1).alias("score"))
