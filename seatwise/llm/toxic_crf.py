"""Toxic spans by a linear-chain conditional random field.

Labels mark documents. A token of a toxic training document counts as toxic if a word or prefix of it is
tied to toxic documents (many times more frequent there, and not by chance); all other tokens, and those
of other documents, count as clean. A two-state chain is fitted to these tokens, with a weight for each
tied word and prefix. For every document, forward-backward marginals give each token's probability of
being toxic; the document's score is a logistic function of them, and tokens that are likelier toxic than
not are returned as offending offsets.

All tokens that hold no tied word or prefix are alike to the chain. In a text without any, the messages at
a token depend only on how many tokens stand before and after it, so they are looked up, not swept again.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatwise.llm.common import SPACES, in_sieve, sieve, stage
from seatwise.llm.labelled import descend, fitting, logistic, ordered_ids, sigmoid

SAMPLE_ROWS = 10_000
SAMPLE_CHARS = 16_000_000
SEED = "toxic-1"

#: A cue is tied to toxic documents from this log ratio of document frequencies, if its G statistic
#: is above twice the log of the number of cues tried by this much, so that chance ties none.
LOG_RATIO = 3.0
G_MORE = 4.0
PREFIXES = (3, 4, 5, 6)
HEAD = min(PREFIXES)

#: Steps of the fit at most, the share of the first gradient at which it ends, and the penalty of a weight by token.
STEPS = 150
ENOUGH = 1e-3
PENALTY = 1e-7

#: Words whose cues a task remembers while it counts, and the longest that it remembers.
MEMORY = 100_000
LONGEST = 48

#: Cues that a task counts before it passes the counts on.
COUNTED = 400_000

#: Tokens that are swept at once; texts of more bytes than LONG are swept in pieces.
TOKENS_AT_ONCE = 1 << 17
LONG = 1 << 20

#: Bytes of text in a chunk of the sample.
CHUNK_BYTES = 1_000_000

#: Places of the bitmap of labelled ids (4 MB).
ID_BITS = 25

EDGES = ".,;:!?\"'()[]{}«»„“”…-*_"
SPACE_BYTES = SPACES.encode()
TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")


@dataclass
class Model:
    tied: dict[str, int]  # the number of each tied cue
    weights: np.ndarray
    bias: float
    start: float
    chain: np.ndarray  # log potentials from state i to state j
    document: np.ndarray
    steady: np.ndarray | None = field(default=None, repr=False)

    def emission(self, word: bytes) -> float | None:
        """The word's log potential of being toxic; None (the bias) if it holds no tied cue."""
        own = numbers(word, self.tied)
        return self.bias + float(self.weights[own].sum()) if own else None

    def emissions(self, words: list[bytes]) -> dict[bytes, float]:
        """Of the words that hold a tied cue. Few words begin as a tied cue does, so most are told by that."""
        heads = self.heads
        near = [w for w in set(words) if w.decode("utf-8", "replace").lower().strip(EDGES)[:HEAD] in heads]
        return {w: e for w in near if (e := self.emission(w)) is not None}

    @cached_property
    def heads(self) -> frozenset[str]:
        return frozenset(c[1:1 + HEAD] for c in self.tied)


def cues(word: bytes) -> list[str]:
    """What can tie a word to toxic documents: itself and its prefixes, without case and outer punctuation."""
    w = word.decode("utf-8", "replace").lower().strip(EDGES)
    return ["w" + w, *("p" + w[:n] for n in PREFIXES if len(w) > n)] if w else []


def numbers(word: bytes, tied: dict[str, int]) -> list[int]:
    return [tied[c] for c in cues(word) if c in tied]


# --- the chain -----------------------------------------------------------------------------------------

def _potentials(emission: np.ndarray, first: np.ndarray, start: float, chain: np.ndarray) -> np.ndarray:
    """(4, tokens): potentials 00, 01, 10, 11 of each step; the first of a text forgets what came before it."""
    toxic = np.exp(np.clip(emission, -30, 30))
    t = np.exp(chain)
    m = np.empty((4, len(emission)))
    m[0], m[1], m[2], m[3] = t[0, 0], t[0, 1] * toxic, t[1, 0], t[1, 1] * toxic
    m[0, first] = m[2, first] = 1.0
    m[1, first] = m[3, first] = np.exp(start) * toxic[first]
    return m


def _carried(m: np.ndarray, v: np.ndarray, backward: bool) -> np.ndarray:
    """One step of a two-state vector, normalised."""
    out = np.stack([v[0] * m[0] + v[1] * m[1], v[0] * m[2] + v[1] * m[3]] if backward else
                   [v[0] * m[0] + v[1] * m[2], v[0] * m[1] + v[1] * m[3]])
    return out / out.sum(axis=0)


def _sweep(m: np.ndarray, backward: bool, enter_with: np.ndarray | None = None) -> np.ndarray:
    """(2, tokens): the normalised forward (or backward) vector at each token, exactly.

    ``enter_with`` is the vector from before the first token (after the last one).

    Stretches of equal length go side by side: first what each makes of either state, then, from
    stretch to stretch, the vector that enters each, then the vectors within.
    """
    n = m.shape[1]
    length = max(1, int(np.sqrt(n)))
    rows = -(-n // length)
    full = np.empty((4, rows * length))
    full[:, :n] = m
    full[:, n:] = np.array([1.0, 0.0, 0.0, 1.0])[:, None]
    full = np.ascontiguousarray(full.reshape(4, rows, length).transpose(2, 0, 1))
    steps = range(length - 1, -1, -1) if backward else range(length)
    made = np.zeros((2, 2, rows))  # what a pure state 0 or 1 becomes, up to one common factor
    made[0, 0] = made[1, 1] = 1.0
    for k in steps:
        a, b, c, d = full[k]
        for v in made:
            x, y = v
            v[0], v[1] = (x * a + y * b, x * c + y * d) if backward else (x * a + y * c, x * b + y * d)
        made /= made.sum(axis=(0, 1))
    enter = np.empty((2, rows))
    v = np.array([0.5, 0.5]) if enter_with is None else enter_with
    for r in (range(rows - 1, -1, -1) if backward else range(rows)):
        enter[:, r] = v
        v = v[0] * made[0, :, r] + v[1] * made[1, :, r]
        v = v / v.sum()
    out = np.empty((length, 2, rows))
    v = enter
    for k in steps:
        if backward:
            out[k] = v
            v = _carried(full[k], v, True)
        else:
            v = _carried(full[k], v, False)
            out[k] = v
    return out.transpose(1, 2, 0).reshape(2, rows * length)[:, :n]


def _probability(forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    both = forward * backward
    return both[1] / both.sum(axis=0)


def marginals(emission: np.ndarray, first: np.ndarray, start: float, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's probability of state 1, and the (4,) expected transitions of steps within texts."""
    m = _potentials(emission, first, start, chain)
    forward, backward = _sweep(m, False), _sweep(m, True)
    pair = np.stack([forward[0, :-1] * m[0, 1:] * backward[0, 1:], forward[0, :-1] * m[1, 1:] * backward[1, 1:],
                     forward[1, :-1] * m[2, 1:] * backward[0, 1:], forward[1, :-1] * m[3, 1:] * backward[1, 1:]])
    inside = np.ones(len(emission), dtype=bool)
    inside[first] = False
    pair = pair[:, inside[1:]]
    return _probability(forward, backward), (pair / pair.sum(axis=0)).sum(axis=1)


def _probabilities(model: Model, emission: np.ndarray, first: np.ndarray) -> np.ndarray:
    m = _potentials(emission, first, model.start, model.chain)
    return _probability(_sweep(m, False), _sweep(m, True))


def _steady(model: Model, n: int) -> np.ndarray:
    """(2, at least n): the share of state 1 in the forward message at each token, and in the backward one that
    so many tokens after it send, in texts without a tied cue."""
    if model.steady is None or model.steady.shape[1] < n:
        size = max(256, 2 * n)
        same = np.full(size, model.bias)
        head = np.array([0])
        m = _potentials(same, head, model.start, model.chain)
        forward = _sweep(m, False)[1]
        m = _potentials(same, np.array([], dtype=int), model.start, model.chain)
        model.steady = np.stack([forward, _sweep(m, True)[1][::-1]])
    return model.steady


def plain_marginals(model: Model, n: int) -> np.ndarray:
    """The marginals of a text of n tokens without a tied cue."""
    f, b = _steady(model, n)[0, :n], _steady(model, n)[1, :n][::-1]
    toxic = f * b
    return toxic / (toxic + (1 - f) * (1 - b))


# --- learning ------------------------------------------------------------------------------------------

def frequencies(rows: DataFrame) -> DataFrame:
    """``cue, clean, toxic``: in how many of the rows' texts of each label a cue occurs; all rows count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[str]] = {}
        seen = (Counter(), Counter())

        def counted() -> pa.RecordBatch:
            both = list(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(both, pa.string()), *(pa.array([s[c] for c in both], pa.int64()) for s in seen)],
                                             ["cue", "clean", "toxic"])
            for s in seen:
                s.clear()
            return out

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found: set[str] = set()
                for w in set(text.as_py().encode("utf-8", "replace").split()):
                    own = known.get(w)
                    if own is None:
                        own = cues(w)
                        if len(w) <= LONGEST:
                            if len(known) >= MEMORY:
                                known.clear()
                            known[w] = own
                    found.update(own)
                seen[label].update(found)
                if len(seen[0]) + len(seen[1]) >= COUNTED:
                    yield counted()
        yield counted()

    return (rows.select("y", "text").mapInArrow(run, "cue string, clean long, toxic long")
            .groupBy("cue").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))


def tied_cues(counts: DataFrame, n_toxic: int, n_clean: int) -> dict[str, int]:
    """The number of each cue that is far more frequent in toxic documents than chance allows; counts are of documents."""
    share = n_toxic / max(1, n_toxic + n_clean)
    tried = counts.count()
    both = F.col("toxic") + F.col("clean")
    ratio = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))

    def part(c: str, expected: float):
        return F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (both * max(expected, 1e-9)))).otherwise(0.0)

    g = 2 * (part("toxic", share) + part("clean", 1 - share))
    tied = counts.filter((ratio > LOG_RATIO) & (g > 2 * float(np.log(tried + 1)) + G_MORE))
    return {r["cue"]: k for k, r in enumerate(sorted(tied.select("cue").collect()))}  # cues of toxic language only


CHUNK = "tokens long, columns binary, sizes binary, ids binary, lengths binary, labels binary, y binary"


def _chunk(texts: list[tuple[int, bytes]], tied: dict[str, int]) -> list:
    """One row of ``CHUNK``: the texts' tokens by number (0 is every word without a tied cue), and the cues of each number."""
    number: dict[bytes, int] = {}
    columns, sizes, ids, lengths = array("i"), array("i", [0]), array("i"), []
    for _, text in texts:
        words = text.split()
        lengths.append(len(words))
        for w in words:
            if w not in number:
                own = numbers(w, tied)
                number[w] = len(sizes) if own else 0
                if own:
                    columns.extend(own)
                    sizes.append(len(own))
            ids.append(number[w])
    columns, sizes, ids = (np.array(x, dtype=np.int32) for x in (columns, sizes, ids))
    y = np.array([label for label, _ in texts], dtype=np.int8)
    labels = np.repeat(y == 1, lengths) & (ids > 0)
    return [len(ids), *(x.tobytes() for x in (columns, sizes, ids, np.array(lengths, dtype=np.int32), labels, y))]


def _chunks(rows: DataFrame, tied: dict[str, int]) -> DataFrame:
    """The rows' texts in chunks of a bounded number of tokens; a longer text is one by itself."""
    shared = rows.sparkSession.sparkContext.broadcast(tied)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([(n, pa.int64() if n == "tokens" else pa.binary()) for n in (c.split()[0] for c in CHUNK.split(", "))])
        own, size = [], 0
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own.append((label, text.as_py().encode("utf-8", "replace")))
                size += len(own[-1][1])
                if size >= CHUNK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(_chunk(own, shared.value), kind)], schema=kind)
                    own, size = [], 0
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(_chunk(own, shared.value), kind)], schema=kind)

    return rows.select("y", "text").mapInArrow(run, CHUNK)


#: A point of the fit: the weights of the cues, then the bias, the start and the chain.
REST = 6


class Runs:
    """Powers of the step matrix of tokens without a cue, by its two eigenvalues.

    Divided by the larger one's power, the matrix of a run of m tokens is ``one + ratio ** m * two``.
    """

    def __init__(self, step: np.ndarray):
        self.step = step
        middle, half = np.trace(step) / 2, np.sqrt(((step[0, 0] - step[1, 1]) / 2) ** 2 + step[0, 1] * step[1, 0])
        self.large, self.small = middle + half, middle - half
        self.one = (step - self.small * np.eye(2)) / (2 * half)
        self.two = np.eye(2) - self.one
        self.ratio = self.small / self.large

    def forward(self, v: np.ndarray, m: np.ndarray) -> np.ndarray:
        out = v @ self.one + (self.ratio ** m)[:, None] * (v @ self.two)
        return out / out.sum(axis=1, keepdims=True)

    def backward(self, v: np.ndarray, m: np.ndarray) -> np.ndarray:
        out = v @ self.one.T + (self.ratio ** m)[:, None] * (v @ self.two.T)
        return out / out.sum(axis=1, keepdims=True)

    def transitions(self, f: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
        """(2, 2): the expected transitions within all runs, between messages ``f`` before and ``b`` after each."""
        power = self.ratio ** m
        f1, f2, b1, b2 = f @ self.one, f @ self.two, b @ self.one.T, b @ self.two.T
        total = (f1 * b).sum(axis=1) + power * (f2 * b).sum(axis=1)
        same1 = m / self.large
        same2 = np.where(m > 0, m * self.ratio ** np.maximum(m - 1, 0), 0) / self.large
        mixed = (1 - power) / (self.large - self.small)
        left, right = f1 * (same1 / total)[:, None] + f2 * (mixed / total)[:, None], f1 * (mixed / total)[:, None] + f2 * (same2 / total)[:, None]
        return self.step * (left.T @ b1 + right.T @ b2)


class Texts:
    """Tokens of texts by number (0: without a cue), ready for sums over the chain.

    A run of tokens without a cue is one step: texts advance side by side from one token with a cue to the next.
    """

    def __init__(self, ids: np.ndarray, first: np.ndarray):
        self.ids, self.first = ids, first
        is_first = np.zeros(len(ids), dtype=bool)
        is_first[first] = True
        at = np.flatnonzero((ids > 0) & ~is_first)
        text = np.searchsorted(first, at, side="right") - 1
        n = np.bincount(text, minlength=len(first))
        order = np.argsort(-n, kind="stable")  # texts with many cues first: those still going are the first ones
        begin, n = (np.cumsum(n) - n)[order], n[order]
        before = np.where(np.diff(text, prepend=-1) != 0, first[text], np.concatenate(([0], at[:-1]))) if len(at) else at
        gap, cue = at - before - 1, ids[at]
        last = np.where(n > 0, at[np.minimum(begin + n - 1, len(at) - 1)] if len(at) else 0, first[order])
        self.rest, self.opening = np.append(first[1:], len(ids))[order] - last - 1, ids[first][order]
        self.steps = []
        for k in range(int(n.max(initial=0))):
            which = begin[:int(np.searchsorted(-n, -k, side="left"))] + k
            self.steps.append((gap[which], cue[which]))

    def expectations(self, emission: np.ndarray, start: float, chain: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """Expected toxic tokens of each number, expected toxic first tokens, and the (2, 2) expected transitions:
        the same sums as of the marginals of all tokens."""
        t = np.exp(chain)
        toxic = np.exp(np.clip(emission, -30, 30))
        runs = Runs(t * np.array([1.0, toxic[0]]))
        expected, pairs = np.zeros(len(emission)), np.zeros((2, 2))
        f = np.stack([np.ones(len(self.first)), np.exp(np.clip(start, -30, 30)) * toxic[self.opening]], axis=1)
        f /= f.sum(axis=1, keepdims=True)
        head, seen = f.copy(), []
        for gap, cue in self.steps:
            going = len(gap)
            enter = f[:going].copy()
            leave = runs.forward(enter, gap)
            step = leave @ t
            step[:, 1] *= toxic[cue]
            f[:going] = step / step.sum(axis=1, keepdims=True)
            seen.append((enter, leave))
        b = np.full((len(self.first), 2), 0.5)
        pairs += runs.transitions(f, b, self.rest)
        b = runs.backward(b, self.rest)
        for (gap, cue), (enter, leave) in zip(reversed(self.steps), reversed(seen)):
            going = len(gap)
            after = b[:going].copy()
            after[:, 1] *= toxic[cue]
            pair = leave[:, :, None] * t * after[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            pairs += pair.sum(axis=0)
            expected += np.bincount(cue, weights=pair[:, :, 1].sum(axis=1), minlength=len(emission))
            back = after @ t.T
            back /= back.sum(axis=1, keepdims=True)
            pairs += runs.transitions(enter, back, gap)
            b[:going] = runs.backward(back, gap)
        p = head[:, 1] * b[:, 1] / (head * b).sum(axis=1)
        expected += np.bincount(self.opening, weights=p, minlength=len(emission))
        # every token but the first is stepped into; those without a cue are what is left of the steps into state 1
        expected[0] = pairs[:, 1].sum() + p.sum() - expected[1:].sum()
        return expected, float(p.sum()), pairs


class Sample:
    """The chunks of the sample, put together."""

    def __init__(self, rows: list[dict]):
        columns, word, ids, n = [], [], [], 1
        for row in rows:
            own, sizes, tokens = (np.frombuffer(row[k], dtype=np.int32) for k in ("columns", "sizes", "ids"))
            columns.append(own)
            word.append(np.repeat(np.arange(len(sizes)), sizes) + n - 1)
            ids.append(np.where(tokens > 0, tokens + n - 1, 0))
            n += len(sizes) - 1  # number 0 is the same in all chunks
        self.columns, self.word, self.ids, self.numbers = np.concatenate(columns), np.concatenate(word), np.concatenate(ids), n
        self.lengths = np.concatenate([np.frombuffer(row["lengths"], dtype=np.int32) for row in rows])
        self.labels = np.concatenate([np.frombuffer(row["labels"], dtype=bool) for row in rows])
        self.y = np.concatenate([np.frombuffer(row["y"], dtype=np.int8) for row in rows])
        self.first = (np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]
        inside = np.ones(len(self.ids), dtype=bool)
        inside[self.first] = False
        steps = 2 * self.labels[:-1].astype(int) + self.labels[1:]
        self.counted = np.bincount(self.ids, weights=self.labels, minlength=n)
        self.opened = float(self.labels[self.first].sum())
        self.stepped = np.bincount(steps[inside[1:]], minlength=4)
        self.texts = Texts(self.ids, self.first)

    def emission(self, point: np.ndarray) -> np.ndarray:
        return point[-REST] + np.bincount(self.word, weights=point[self.columns], minlength=self.numbers)

    def gradient(self, point: np.ndarray) -> np.ndarray:
        """Of the negative log-likelihood, at the point."""
        out = np.zeros(len(point))
        if not len(self.ids):
            return out
        expected, opened, pairs = self.texts.expectations(self.emission(point), point[1 - REST], point[2 - REST:].reshape(2, 2))
        expected -= self.counted
        out[:-REST] = np.bincount(self.columns, weights=expected[self.word], minlength=len(point) - REST)
        out[-REST] = expected.sum()
        out[1 - REST] = opened - self.opened
        out[2 - REST:] = pairs.ravel() - self.stepped
        return out

    def first_point(self, n_cues: int) -> np.ndarray:
        """Where the fit starts: the chain from the counted transitions, all cues alike."""
        to = 1.0 + self.stepped.reshape(2, 2)
        point = np.zeros(n_cues + REST)
        point[1 - REST] = np.log((1 + self.opened) / (1 + len(self.first) - self.opened))
        point[2 - REST:] = np.log(to / to.sum(axis=1, keepdims=True)).ravel()
        return point

    def fitted(self, n_cues: int) -> np.ndarray:
        return descend(lambda point: self.gradient(point) + PENALTY * len(self.ids) * point, self.first_point(n_cues), STEPS, ENOUGH)

    def summaries(self, point: np.ndarray) -> np.ndarray:
        """Summary of each text, from its tokens' marginals."""
        emission, out = self.emission(point), []
        ends = np.cumsum(self.lengths)
        at = 0
        while at < len(ends):  # a bounded number of tokens at once
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOKENS_AT_ONCE, side="right")))
            lengths, begin = self.lengths[at:stop], int(ends[at - 1]) if at else 0
            own = emission[self.ids[begin:int(ends[stop - 1])]]
            first = (np.cumsum(lengths) - lengths)[lengths > 0]
            p = marginals(own, first, point[1 - REST], point[2 - REST:].reshape(2, 2))[0] if len(own) else np.zeros(0)
            out += [_summary(q) for q in np.split(p, np.cumsum(lengths)[:-1])]
            at = stop
        return np.array(out).reshape(-1, N_SUMMARY)


def _fitted(chunks: DataFrame, n_cues: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The fit's point, and summary and label of each text of the sample; one task, as the sample is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]
        if rows:
            sample = Sample(rows)
            point = sample.fitted(n_cues)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.tobytes()], pa.binary()) for x in (point, sample.summaries(point), sample.y)], ["point", "x", "y"])

    row = chunks.coalesce(1).mapInArrow(run, "point binary, x binary, y binary").first()
    return np.frombuffer(row["point"]), np.frombuffer(row["x"]).reshape(-1, N_SUMMARY), np.frombuffer(row["y"], dtype=np.int8)


def _with_label(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, y``: only texts whose id has its place in a bitmap of the labelled ids meet the labels."""
    key = F.xxhash64(F.col("doc_id").cast("string"))
    bitmap = docs.sparkSession.sparkContext.broadcast(sieve(labels, key, ID_BITS))
    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), key.alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_sieve(bitmap.value, batch.column(2).to_numpy(), ID_BITS)))

    return rows.mapInArrow(run, rows.schema).drop("key").join(labels, "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic",
        held_out: str = "pmod(crc32(cast(doc_id as string)), 3) = 1", sample_rows: int = SAMPLE_ROWS,
        sample_chars: int = SAMPLE_CHARS) -> Model:
    """Learns from labelled rows for which ``held_out`` is not true.

    What is tied to toxic documents follows from all of them. The chain is fitted, in a task, to a
    sample: at most ``sample_rows`` documents and ``sample_chars`` characters of each label, those of the
    smallest seeded hash. Null labels and ids are no labels; an id labelled both ways counts as toxic;
    texts that repeat within a label count once. Without toxic rows to learn from every score is 0.
    """
    labels = (labels.filter(f"{label_col} IS NOT NULL AND doc_id IS NOT NULL AND NOT coalesce({held_out}, false)")
              .groupBy("doc_id").agg(F.max(label_col).alias("y")))
    labels = stage(labels.filter("y IN (0, 1)"), "labels")
    size = {r["y"]: r["n"] for r in labels.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rows = (_with_label(docs, labels).groupBy("y", F.xxhash64("text").alias("hash"))
            .agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text")).select("doc_id", "y", "text"))
    rows = stage(rows, "labelled")
    return learn(rows, size, sample_rows, sample_chars)


def learn(rows: DataFrame, size: dict[int, int], sample_rows: int, sample_chars: int) -> Model:
    """The model of the labelled texts ``doc_id, y, text``; ``size``: how many labelled rows there are of each."""
    nothing = Model({}, np.zeros(0), -30.0, -30.0, np.array([[0.0, -30.0], [0.0, -30.0]]), np.array([0.0] * N_SUMMARY + [-35.0]))
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(1):
        return nothing
    tied = tied_cues(stage(frequencies(rows), "frequencies"), n[1], n.get(0, 0))
    own = {y: rows.filter(F.col("y") == y).select("doc_id", "text") for y in (0, 1)}
    sample = [fitting(own[y], ordered_ids(own[y], sample_rows, SEED), sample_chars).withColumn("y", F.lit(y)) for y in (0, 1)]
    chunks = stage(_chunks(sample[0].unionByName(sample[1]), tied), "chunks")
    if not chunks.agg(F.sum("tokens")).first()[0]:
        return nothing
    point, x, y = _fitted(chunks, len(tied))
    sampled = np.array([size.get(k, 0) / max(1, int((y == k).sum())) for k in (0, 1)])
    return Model(tied, point[:-REST], float(point[-REST]), float(point[1 - REST]), point[2 - REST:].reshape(2, 2),
                 logistic(x, y.astype(float), sampled[y]))


# --- scoring -------------------------------------------------------------------------------------------

def _emissions(model: Model, words: list[bytes]) -> np.ndarray | None:
    """Of each word; None if none holds a tied cue."""
    tied = model.emissions(words)
    if not tied:
        return None
    return np.fromiter((tied.get(w, model.bias) for w in words), dtype=np.float64, count=len(words))


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text cut at white space; a piece is longer than LONG only if a word is."""
    at = 0
    while at < len(text):
        cut = TOKEN.search(text, min(len(text), at + LONG))
        end = len(text) if cut is None else cut.start()
        if cut is not None and end == at + LONG and text[end - 1] not in SPACE_BYTES:
            end = cut.end()  # the word began before
        yield text[at:end]
        at = end


def long_marginals(model: Model, text: bytes) -> np.ndarray:
    """The marginals of a long text, piece by piece: forward to learn the message that enters each, then backward."""
    bounds, at = [], 0
    for piece in _pieces(text):
        bounds.append((at, at + len(piece)))
        at += len(piece)

    def potentials(a: int, b: int, begins: bool) -> np.ndarray:
        words = text[a:b].split()
        e = _emissions(model, words)
        e = np.full(len(words), model.bias) if e is None else e
        return _potentials(e, np.array([0] if begins else [], dtype=int), model.start, model.chain)

    bounds = [x for x in bounds if text[slice(*x)].strip(SPACE_BYTES)]
    enter, v = [], None
    for k, x in enumerate(bounds):
        enter.append(v)
        v = _sweep(potentials(*x, k == 0), False, v)[:, -1]
    out, v = [], None
    for k, x in reversed(list(enumerate(bounds))):
        m = potentials(*x, k == 0)
        backward = _sweep(m, True, v)
        out.append(_probability(_sweep(m, False, enter[k]), backward))
        v = _carried(m[:, 0], backward[:, 0], True)
    return np.concatenate(out[::-1]) if out else np.zeros(0)


def _token_marginals(model: Model, texts: list[bytes]) -> list[np.ndarray]:
    """The marginals of each text's tokens; texts with tied cues are swept, a bounded number of tokens at once."""
    out: list[np.ndarray] = []
    swept, emissions, size = [], [], 0

    def sweep() -> None:
        nonlocal swept, emissions, size
        ends = np.cumsum([len(e) for e in emissions])
        p = _probabilities(model, np.concatenate(emissions), np.concatenate(([0], ends[:-1])))
        for k, q in zip(swept, np.split(p, ends[:-1])):
            out[k] = q
        swept, emissions, size = [], [], 0

    for text in texts:
        if len(text) > LONG:
            out.append(long_marginals(model, text))
            continue
        words = text.split()
        e = _emissions(model, words)
        out.append(plain_marginals(model, len(words)) if e is None else np.zeros(0))
        if e is not None:
            swept.append(len(out) - 1)
            emissions.append(e)
            size += len(e)
            if size >= TOKENS_AT_ONCE:
                sweep()
    if swept:
        sweep()
    return out


N_SUMMARY = 2


def _summary(p: np.ndarray) -> tuple[float, ...]:
    """Of a text's marginals: how sure it is that some token is toxic, and how many there may be."""
    return float(p.max(initial=0)), float(np.log1p(p[p > 0.1].sum()))


def _spans(text: bytes, p: np.ndarray) -> list[dict]:
    """Character offsets of the tokens that are likelier toxic than not."""
    if not (p >= 0.5).any():
        return []
    out, at, chars = [], 0, 0
    for q, m in zip(p.tolist(), TOKEN.finditer(text)):
        if q >= 0.5:
            chars += len(text[at:m.start()].decode("utf-8", "replace"))
            size = len(m.group().decode("utf-8", "replace"))
            out.append({"start": chars, "end": chars + size, "probability": q})
            at, chars = m.end(), chars + size
    return out


def _read(model: Model, batches: Iterator[pa.RecordBatch], column: int
          ) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[np.ndarray], np.ndarray]]:
    """Slices of the batches, with their texts, token marginals and scores; a bounded number of tokens at once."""
    for batch in batches:
        texts, at, size = [], 0, 0
        for n in range(batch.num_rows):
            text = batch.column(column)[n].as_py() or b""
            texts.append(text if isinstance(text, bytes) else text.encode("utf-8", "replace"))
            size += len(texts[-1])
            if size >= 8 * TOKENS_AT_ONCE or n + 1 == batch.num_rows:
                p = _token_marginals(model, texts)
                x = np.array([_summary(q) for q in p]).reshape(-1, N_SUMMARY)
                yield batch.slice(at, len(texts)), texts, p, sigmoid(x @ model.document[:-1] + model.document[-1])
                texts, at, size = [], n + 1, 0


def without_toxic(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below ``threshold``; see :func:`tag`."""
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _, score in _read(model, batches, column):
            yield part.filter(pa.array(score < threshold))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names with dots can't be passed to Python
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def tag(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: ``doc_id, score, spans``, spans of (start, end, probability) in characters.

    Every token of every text is scored. Null and empty texts have no tokens: their score is that of a
    text without any toxic token. Repeated rows and null ids are kept; an empty table gives an empty
    result; other columns play no part.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, p, score in _read(model, batches, 1):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(score), pa.array([_spans(t, q) for t, q in zip(texts, p)], pa.list_(span))],
                ["doc_id", "score", "spans"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double, spans array<struct<start: bigint, end: bigint, probability: double>>")
