"""Masked pseudo-likelihood: a bidirectional window network predicts every token from both sides.

Tokens are lower-case words. A frequent word is a class of its own; the others share classes by their endings. There are
four times the square root of the counted words of classes, in groups of the square root of their number. The probability
of a word given its neighbours is that of its group, times that of its class in the group, both from the network, times,
for words that are no class of their own, the word's share of its class in the corpus. The network looks at two words on
either side: a row of a table for each place, summed, tanh, and the two softmaxes, whose biases start at the corpus's own
frequencies. A text's score is the sum of the logarithms.

Word counts cover all documents, and every word's share comes from its own count: tasks hold those of the most frequent
words, the others are joined. Words are told apart by 64-bit keys of 48 bits of hash and 16 of the ending. Texts are split
and looked up once; training and scoring read their classes. Training covers all documents: in each of a few rounds
replicas of a fixed number of words train on the documents of that round; the replicas are averaged as a tree, weighted
by tokens. Training and scoring both predict every place of every text."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonweave.llm.common import LOWERED, hash_words, map_rows, materialize, mix, parts_of, roomy, split_words
from codonweave.session import discard, ship

#: Units; neighbours on each side; rounds.
UNITS, SIDE, ROUNDS = 24, 2, 2
#: Classes in a group by the fourth root of the counted words, and at least; words whose counts tasks hold, by the square root.
GROUP, LEAST_GROUP, HELD = 2, 8, 100
#: Words that a replica trains on at least, where there are so many.
REPLICA_WORDS = 8_000_000
BATCH, RATE = 2048, 0.1
#: Tokens that are scored or counted at once; weights in a row when replicas are averaged; rows that are averaged at once.
SCORED, COUNTED, BLOCK, FAN = 8192, 4_000_000, 1 << 15, 32

#: Bytes whose words are told apart or looked up at once: what is made of them stays below the size from which glibc maps arrays anew.
KEYED = 1 << 18
#: Its tanh is one in floats of 32 and of 64 bits.
ONE = 40
#: exp of so much, either way, is far from the bounds of 32-bit floats; runs of up to SHORT rows are added up row by row;
#: weights that are moved at once.
SAFE, SHORT, AT_ONCE = 60, 8, 1 << 15

_PLACES = [k for k in range(2 * SIDE + 1) if k != SIDE]


# Words


#: Five bits of a byte in an ending: 1 to 26 letters, 27 digits, 28 other ASCII, 29 to 31 the rest.
_LETTER = np.array([b - 96 if 97 <= b <= 122 else 27 if 48 <= b <= 57 else 28 if b < 128 else 29 + b % 3 for b in LOWERED.tolist()], np.uint64)
_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words of some texts, one after another, and the number of words of each text; a null text has none."""
    rows = max(1, len(texts) * KEYED // max(1, texts.nbytes))
    found = [_keys(texts.slice(a, rows)) for a in range(0, max(1, len(texts)), rows)]
    return np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found])


def _keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, starts, ends, lengths = split_words(texts)
    keys = mix(hash_words(raw, starts, ends))
    tail = ends - (_MARK[raw[ends - 1]] & (ends - starts > 1)) if len(ends) else ends
    code = np.zeros(len(starts), np.uint64)
    for back in (3, 2, 1):
        at = tail - back
        code = code * np.uint64(32) + (np.where(at >= starts, _LETTER[raw[np.maximum(at, 0)]], 0).astype(np.uint64) if len(ends) else code)
    return (keys & np.uint64(0xFFFFFFFFFFFF0000)) | code, lengths


class Lookup:
    """Places of 64-bit keys in an array of distinct ones: a table of linear probes, a fourth full at most."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        self.slots = np.full((1 << (64 - int(self.shift))) + len(keys) + 1, -1, np.int32)
        left = np.arange(len(keys))
        spot = (mix(keys) >> self.shift).astype(np.int64)
        while len(left):
            free = self.slots[spot] < 0
            self.slots[spot[free]] = left[free]  # of several at one slot one stays
            placed = self.slots[spot] == left
            left, spot = left[~placed], spot[~placed] + 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for others."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        spot = (mix(keys) >> self.shift).astype(np.int64)
        out = self.slots[spot].astype(np.int64)
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(open_):
            spot[open_] += 1
            got = self.slots[spot[open_]].astype(np.int64)
            out[open_] = got
            open_ = open_[(got >= 0) & (self.keys[got] != keys[open_])]
        return out


# Model


class Parts(tuple):
    """Views of a flat array of weights: table (place, class, unit), bias, out, its bias, inner (group), its biases.

    A class's rows for all places lie side by side, that of the last place first, and biases behind the weights that they belong
    to. These are whole: rows (class, place and unit), bias, outer (unit and one more, group) and within (group, unit and one
    more, class in the group)."""

    def __new__(cls, weights: np.ndarray, classes: int, g: int) -> Parts:
        rows, bias, outer, within = np.split(weights, np.cumsum(cls._sizes(classes, g))[:-1])
        whole = rows.reshape(classes + 1, 2 * SIDE * UNITS), bias, outer.reshape(UNITS + 1, g), within.reshape(g, UNITS + 1, g)
        _, _, outer, within = whole
        table = rows.reshape(classes + 1, 2 * SIDE, UNITS)[:, ::-1].transpose(1, 0, 2)
        made = super().__new__(cls, (table, bias, outer[:-1], outer[-1], within[:, :-1], within[:, -1]))
        made.weights, made.whole = weights, whole
        return made

    @staticmethod
    def _sizes(classes: int, g: int) -> tuple[int, ...]:
        return 2 * SIDE * (classes + 1) * UNITS, UNITS, (UNITS + 1) * g, g * (UNITS + 1) * g

    @classmethod
    def size(cls, classes: int, g: int) -> int:
        return sum(cls._sizes(classes, g))


def group_size(distinct: int) -> int:
    """Classes in a group, and groups, for so many counted words."""
    return max(LEAST_GROUP, math.ceil(GROUP * distinct**0.25))


class Model:
    """Counts of frequent words, class totals and network; counts, not sent to tasks, is the table of all words."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, endings: dict[int, int], distinct: int, counts: DataFrame | None = None) -> None:
        """keys, n: held words and their counts, the most frequent first; endings: occurrences of all words by ending."""
        self.counts, self.keys, self.n = counts, keys, n
        self.group = group_size(distinct)
        self.classes = self.group**2
        self.single = min(len(keys), self.classes * 3 // 4)
        codes = np.zeros(1 << 16, np.float64)
        codes[list(endings.keys())] = list(endings.values())
        np.subtract.at(codes, (keys[: self.single] & np.uint64(0xFFFF)).astype(np.int64), n[: self.single])
        # the most usual endings of the other words have classes, the others share as many
        many = self.classes - self.single
        self.ending = self.single + np.arange(1 << 16) % max(1, many // 2)
        top = np.argsort(-codes, kind="stable")[: many - max(1, many // 2)]
        self.ending[top] = self.single + max(1, many // 2) + np.arange(len(top))
        totals = np.ones(self.classes)  # one occurrence of each class is left to words that nobody has seen
        totals[: self.single] += n[: self.single]
        np.add.at(totals, self.ending, np.maximum(codes, 0))
        self.totals = np.log(totals)
        rng = np.random.default_rng(11)
        g = self.group
        parts, inside = self.parts(np.zeros(Parts.size(self.classes, g), np.float32)), totals.reshape(g, g)
        for k in (0, 2, 4):
            parts[k][:] = rng.normal(0, 0.1, parts[k].size).reshape(parts[k].shape)
        parts[3][:] = np.log(inside.sum(axis=1) / totals.sum())
        parts[5][:] = np.log(inside / inside.sum(axis=1, keepdims=True))
        self.weights = parts.weights
        self._lookup: Lookup | None = None
        self._logs: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"counts": None, "_lookup": None, "_logs": None}

    def parts(self, weights: np.ndarray) -> Parts:
        return Parts(weights, self.classes, self.group)

    def encode(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word its class, its log share of the class, and whether its own count is not held; the share is then that of one occurrence."""
        if self._lookup is None:
            self._lookup, self._logs = Lookup(self.keys), np.log(np.append(self.n, 1).astype(np.float64))
        some = KEYED // 8
        if len(keys) > some:
            return tuple(np.concatenate(x) for x in zip(*[self.encode(keys[a : a + some]) for a in range(0, len(keys), some)]))
        at = self._lookup.find(keys)
        own = (at >= 0) & (at < self.single)
        cls = np.where(own, at, self.ending[(keys & np.uint64(0xFFFF)).astype(np.int64)])
        times = self._logs[at]  # -1: the last
        return cls.astype(np.int32), np.where(own, 0.0, times - self.totals[cls]), at < 0


def padded(ids: np.ndarray, lengths: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of some texts with SIDE edges before, between and behind the texts, and where each word stands there."""
    at = np.arange(len(ids)) + np.repeat(np.arange(1, len(lengths) + 1) * SIDE, lengths)
    row = np.full(len(ids) + SIDE * (len(lengths) + 1), edge, np.int32)
    row[at] = ids
    return row, at


def _apart(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As padded(), for words whose neighbours, by place, are given: each stands apart from the others."""
    n = windows.shape[1]
    row = np.zeros((n, 2 * SIDE + 1), np.int32)
    row[:, _PLACES] = windows.T
    return row.ravel(), np.arange(n) * (2 * SIDE + 1) + SIDE


def _stretch(row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of row that the words at some places and their neighbours take, and their places in it."""
    return row[at[0] - SIDE : at[-1] + SIDE + 1], at - (at[0] - SIDE)


def _order(x: np.ndarray, top: int) -> np.ndarray:
    """A stable order of numbers below top; those of 16 bits are sorted by digits."""
    return np.argsort(x.astype(np.uint16) if top <= 1 << 16 else x, kind="stable")


def _laid(x: np.ndarray, many: int, width: int, first: int, apart: int) -> np.ndarray:
    """Runs of width numbers of flat x as one item each, many of them, that begin at first and then apart numbers further each."""
    return np.ndarray(many, np.dtype((np.void, width * x.itemsize)), x, first * x.itemsize, (apart * x.itemsize,))


def hidden(whole: tuple, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hidden units of the words at some places of row, and a one behind them, with which biases are weights as others.

    As rows of a class lie side by side from the last place to the first, what the neighbours of a word add lies at equal
    distances on either side of it, so the sums of all words are sums of the whole array with itself, moved."""
    rows, bias = whole[:2]
    wide = 2 * SIDE * UNITS
    x = np.take(rows, row, axis=0, mode="clip").ravel()
    step, far = wide - UNITS, (SIDE + 1) * wide - SIDE * UNITS
    size = len(x) - (SIDE - 1) * step
    side = sum((x[k * step : k * step + size] for k in range(1, SIDE)), x[:size])
    both = side[:-far] + side[far:]
    h = _laid(both, len(row) - 2 * SIDE, UNITS + 1, step, wide)[at - SIDE].view(x.dtype).reshape(-1, UNITS + 1)
    h += np.append(bias, x.dtype.type(0))
    h[:, -1] = ONE
    return np.tanh(h, out=h)


def _exp(z: np.ndarray) -> np.ndarray:
    """Turns z into exp of z, each row up to a factor, and returns the row sums."""
    if max(z.max(), -z.min()) > SAFE:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    return z @ np.ones(z.shape[1], z.dtype)


def _segments(cls: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, slice]]]:
    """Of sorted classes, the numbers of their groups and of themselves in a flat array with a row of size for each word, and (group, slice)."""
    group, inner = np.divmod(cls, size)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    ends = np.append(first[1:], len(cls)).tolist()
    row = np.arange(0, len(cls) * size, size)
    return row + group, row + inner, [(g, slice(a, b)) for g, a, b in zip(group[first].tolist(), first.tolist(), ends)]


def log_probabilities(parts: Parts, windows: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Logarithms of the probabilities of the classes cls, that of the group and that in the group, with any neighbours, by place."""
    return log_probabilities_along(parts, *_apart(windows), cls)


def log_probabilities_along(parts: Parts, row: np.ndarray, at: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """As log_probabilities(), with the neighbours that the places at have in row."""
    _, _, outer, within = parts.whole
    order, h = _order(cls, len(within) ** 2), np.empty((len(cls), UNITS + 1), outer.dtype)
    for a in range(0, len(cls), BATCH):
        h[a : a + BATCH] = hidden(parts.whole, *_stretch(row, at[a : a + BATCH]))
    items = _laid(h, len(h), UNITS + 1, 0, UNITS + 1)
    result = np.empty(len(cls))
    for a in range(0, len(cls), BATCH):
        some = order[a : a + BATCH]
        group, own, segments = _segments(cls[some], len(within))
        units = items[some].view(h.dtype).reshape(-1, UNITS + 1)
        z = units @ outer
        total = _exp(z)
        p = (np.take(z, group) / total).astype(np.float64)
        for g, s in segments:
            np.dot(units[s], within[g], out=z[s])
        total = _exp(z)
        p *= np.take(z, own) / total
        result[some] = np.log(np.maximum(p, 1e-60))
    return result


def _sums(rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of runs of rows that begin at first, the longest run first, and the numbers of the runs in that order."""
    lengths = np.diff(np.append(first, len(rows)))
    runs = np.argsort(-lengths, kind="stable")
    starts, falling = np.take(first, runs), -np.take(lengths, runs)
    out = np.take(rows, starts, axis=0)
    long = int(np.searchsorted(falling, -SHORT))
    for k, (a, n) in enumerate(zip(starts[:long].tolist(), falling[:long].tolist())):
        np.add.reduce(rows[a : a - n], axis=0, out=out[k])
    for r in range(1, SHORT):
        here = slice(long, int(np.searchsorted(falling, -r)))
        out[here] += np.take(rows, starts[here] + r, axis=0)
    return out, runs


def _moves(squares: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Adds the squares of the slope g to squares; g becomes the AdaGrad move."""
    x = g * g
    squares += x
    np.sqrt(squares, out=x)
    x += 1e-6
    g /= x
    g *= RATE
    return g


def _put(rows: np.ndarray, ids: np.ndarray, new: np.ndarray) -> None:
    """rows[ids] = new, each row as one item."""
    item = np.dtype((np.void, new.shape[1] * new.itemsize))
    rows.view(item)[ids] = new.view(item)


def step(parts: Parts, squares: Parts, windows: np.ndarray, cls: np.ndarray) -> None:
    """One AdaGrad step on a batch of words with any neighbours, by place."""
    step_along(parts, squares, *_apart(windows), cls)


def step_along(parts: Parts, squares: Parts, row: np.ndarray, at: np.ndarray, cls: np.ndarray) -> None:
    """One AdaGrad step on the words cls, whose neighbours are those that the places at have in row."""
    table, _, outer, within = parts.whole
    n, order = len(cls), _order(cls, len(within) ** 2)
    at = at[order]
    group, own, segments = _segments(cls[order], len(within))
    h = hidden(parts.whole, row, at)
    p = h @ outer
    p /= (_exp(p) * n)[:, None]
    p.reshape(-1)[group] -= 1 / n
    q, inner = np.empty_like(p), list(within)
    mine = [(g, h[s], q[s], s) for g, s in segments]
    for g, x, y, _ in mine:
        np.dot(x, inner[g], out=y)
    q /= (_exp(q) * n)[:, None]
    q.reshape(-1)[own] -= 1 / n
    dh, back = p @ outer.T, np.empty_like(h)
    slope, slopes, turned = h.T @ p, np.zeros_like(within), list(within.transpose(0, 2, 1))
    for g, x, y, s in mine:
        np.dot(y, turned[g], out=back[s])
        np.dot(x.T, y, out=slopes[g])
    dh += back
    dh *= 1 - h * h  # nothing for the one
    for k, g in ((1, dh.sum(axis=0)[:-1]), (2, slope), (3, slopes)):
        few = max(1, AT_ONCE * len(g) // g.size)
        for a in range(0, len(g), few):
            parts.whole[k][a : a + few] -= _moves(squares.whole[k][a : a + few], g[a : a + few])
    # each row of the table is moved once by the sum of the slopes of its class, wherever that stands, for all places
    spread = np.zeros((len(row) + 2 * SIDE, UNITS), h.dtype)
    spread[at + SIDE] = dh[:, :-1]
    by = _order(row, len(table))
    ids = np.take(row, by)
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    halves = _laid(spread, len(row) + SIDE + 1, SIDE * UNITS, 0, UNITS)[np.stack([by, by + SIDE + 1], axis=1)]
    g, runs = _sums(halves.view(h.dtype).reshape(len(row), -1), first)
    ids = np.take(ids, np.take(first, runs))
    sums = squares.whole[0]
    sum_, weight = np.take(sums, ids, axis=0), np.take(table, ids, axis=0)
    weight -= _moves(sum_, g)
    _put(sums, ids, sum_)
    _put(table, ids, weight)


# Jobs


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all documents, by key: counted within each task first, then by word."""

    def count(keys: list[np.ndarray]) -> pa.RecordBatch:
        x = np.sort(np.concatenate([*keys, np.empty(0, np.uint64)]))
        first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x[first].view(np.int64)), pa.array(np.diff(np.append(first, len(x))))], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roomy()
        waiting: list[np.ndarray] = []
        for batch in parts_of(batches):
            waiting.append(word_keys(batch.column(0))[0])
            if sum(map(len, waiting)) >= COUNTED:
                yield count(waiting)
                waiting = []
        yield count(waiting)

    ship(docs.sparkSession)
    return docs.select(F.col(text).cast("string")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def start(docs: DataFrame, held: int = HELD) -> Model:
    """The model before training: counts of all words, those of the most frequent held * sqrt(words) in the model."""
    counts = materialize(word_counts(docs))
    distinct = counts.count()
    most = max(held * math.isqrt(distinct), group_size(distinct) ** 2)
    # the least count at which no more words than that are held, from the words by count
    levels = sorted(((r["n"], r["words"]) for r in counts.groupBy("n").agg(F.count("*").alias("words")).collect()), reverse=True)
    least, seen = None, 0
    for n, words in levels:
        if seen + words > most:
            break
        least, seen = n, seen + words
    top = counts.filter(F.col("n") >= least).toArrow() if least is not None else counts.limit(0).toArrow()
    keys, n = top["word"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.lexsort((keys, -n))
    endings = counts.groupBy(F.col("word").bitwiseAND(F.lit(0xFFFF)).alias("code")).agg(F.sum("n").alias("n")).collect()  # 2^16 rows at most
    return Model(keys[order], n[order], {r["code"]: r["n"] for r in endings}, distinct, counts)


def encoded(docs: DataFrame, model: Model) -> DataFrame:
    """row, doc_id, n_tokens, ids (classes, little-endian 32-bit), share (sum of log shares), rare (keys of words whose count
    is not held) of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roomy()
        for batch in parts_of(batches):
            keys, lengths = word_keys(batch.column("text"))
            cls, share, rare = shared.value.encode(keys)
            ends = np.concatenate(([0], np.cumsum(lengths)))
            sums = np.concatenate(([0.0], np.cumsum(share)))
            rares = np.concatenate(([0], np.cumsum(rare)))[ends]
            ids = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(cls.astype("<i4"))])
            lists = pa.ListArray.from_arrays(pa.array(rares.astype(np.int32)), pa.array(keys[rare].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(lengths), ids, pa.array(np.diff(sums[ends])), lists], names=["row", "doc_id", "n_tokens", "ids", "share", "rare"])

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"row long, doc_id {kind}, n_tokens long, ids binary, share double, rare array<long>")


def _flat(ids: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Classes of some texts, one after another, and their lengths."""
    return np.frombuffer(b"".join(ids), "<i4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4


def average(replicas: DataFrame) -> DataFrame:
    """block, n, w (little-endian floats): the mean of each block over replicas (replica, block, n, w), weighted by n.

    Replicas are averaged FAN at a time, level by level, so no task holds more."""

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].to_numpy(np.float64)
        w = sum(np.frombuffer(x, "<f4") * k for x, k in zip(pdf["w"], n)) / n.sum()
        return pd.DataFrame({"replica": pdf["replica"][:1] // FAN, "block": pdf["block"][:1], "n": [int(n.sum())], "w": [w.astype("<f4").tobytes()]})

    last = replicas.agg(F.max("replica")).first()[0]
    while last:
        replicas = replicas.groupBy(F.floor(F.col("replica") / FAN).alias("_of"), F.col("block").alias("_block")).applyInPandas(mean, "replica long, block long, n long, w binary")
        last //= FAN
    return replicas.select("block", "n", "w")


def fit(texts: DataFrame, model: Model, rounds: int = ROUNDS, replica_words: int = REPLICA_WORDS) -> Model:
    """Trains model on texts (row, n_tokens, ids of encoded()), each in one of the rounds, and returns it."""
    words = texts.agg(F.sum("n_tokens")).first()[0] or 0
    replicas = max(1, words // replica_words)
    for k in range(rounds):
        shared = texts.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            roomy()
            model = shared.value
            weights = model.weights.copy()
            parts, squares = model.parts(weights), model.parts(np.full(len(weights), 1e-3, np.float32))
            seen = 0
            row, at = np.empty(0, np.int32), np.empty(0, np.int64)

            def learn(at: np.ndarray) -> None:
                step_along(parts, squares, *_stretch(row, at), row[at])

            for pdf in batches:
                more, places = padded(*_flat(pdf["ids"]), model.classes)
                row, at = np.append(row, more), np.append(at, places + len(row))
                full = len(at) // BATCH * BATCH
                for a in range(0, full, BATCH):
                    learn(at[a : a + BATCH])
                seen += full
                if full < len(at):
                    row, at = _stretch(row, at[full:])
                else:
                    row, at = row[:0], at[:0]
            if len(at):
                learn(at)
                seen += len(at)
            if seen:
                own = TaskContext.get().partitionId()
                for b, a in enumerate(range(0, len(weights), BLOCK)):
                    yield pd.DataFrame({"replica": [own], "block": [b], "n": [seen], "w": [weights[a : a + BLOCK].astype("<f4").tobytes()]})

        mine = texts.filter((F.pmod("row", F.lit(rounds)) == k) & (F.col("n_tokens") > 0)).select("ids")
        trained = materialize(map_rows(mine.coalesce(replicas), run, "replica long, block long, n long, w binary"))
        for r in average(trained).collect():
            model.weights[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["w"], "<f4")
        discard(trained)
    return model


def score_encoded(texts: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_log_likelihood of every row of encoded()."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roomy()
        model = shared.value
        parts = model.parts(model.weights)
        for pdf in batches:
            ids, lengths = _flat(pdf["ids"])
            row, at = padded(ids, lengths, model.classes)
            logs = [log_probabilities_along(parts, *_stretch(row, at[a : a + SCORED]), ids[a : a + SCORED]) for a in range(0, len(ids), SCORED)]
            sums = np.concatenate(([0.0], np.cumsum(np.concatenate([np.empty(0), *logs]))))
            ends = np.concatenate(([0], np.cumsum(lengths)))
            yield pd.DataFrame({"row": pdf["row"], "doc_id": pdf["doc_id"], "n_tokens": pdf["n_tokens"], "own": pdf["share"] + np.diff(sums[ends])})

    kind = texts.schema["doc_id"].dataType.simpleString()
    own = map_rows(texts.select("row", "doc_id", "n_tokens", "share", "ids"), run, f"row long, doc_id {kind}, n_tokens long, own double")
    rare = texts.select("row", F.explode("rare").alias("word"))
    logs = rare.join(model.counts.filter("n > 1"), "word").groupBy("row").agg(F.sum(F.log("n")).alias("more"))
    out = own.join(logs, "row", "left").select("doc_id", "n_tokens", (F.col("own") + F.coalesce("more", F.lit(0.0))).alias("log_likelihood"))
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))


def train(docs: DataFrame, rounds: int = ROUNDS, held: int = HELD) -> Model:
    """The model of all texts of docs (columns doc_id and text)."""
    model = start(docs, held)
    return fit(materialize(encoded(docs, model)), model, rounds)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_log_likelihood (null without tokens) of every row of docs.

    Null and empty texts have no tokens and the sum 0; a word that the model has not seen has the share of one that occurs once.
    Repeated rows score alike; other columns are left out. The counts of words that tasks do not hold are joined by word;
    those of one add nothing."""
    return score_encoded(materialize(encoded(docs, model)), model)


def train_and_score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """score(docs, train(docs)), with texts split and looked up once."""
    model = start(docs)
    texts = materialize(encoded(docs, model))
    return score_encoded(texts, fit(texts, model, rounds))
