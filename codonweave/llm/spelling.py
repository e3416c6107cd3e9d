"""Spelling variants: words that differ by one inserted, deleted or replaced character, found with Bloom filters.

Each word's deletions, and its replacements by a greater character, are probed against blocked Bloom filters of the
vocabulary: one filter a word length, whose blocks are 64-bit numbers with BITS bits set for a word. Only what a filter lets pass
is joined with the vocabulary, which leaves out what the filter took wrongly. The longer word of an insertion finds the shorter, and the word
of the lesser character the other, so each pair is found once. Hashes of edits come from the word's own running sums.

Filters that are broadcast together hold at most FILTER_BYTES; other lengths have a pass of their own over the words
that can probe them, and a length with more words than that is divided by hash."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonweave.llm.common import mix, parts_of
from codonweave.session import discard, materialize, ship

#: Least length and count of a word; how many times as frequent its form is.
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: A run in this many, by its hash with its document's id, loses a character.
ODDS = 31
#: Bits set in a block for a word, bytes of filter a word, and of filters that are broadcast together.
BITS, WORD_BYTES, FILTER_BYTES = 4, 2, 64 << 20
#: Words of this length and longer share a filter.
LONGEST = 64
#: Words that a task counts before it hands its counts on, words of a probing task, and probes at once.
COUNTED, TASK_WORDS, PROBES = 200_000, 20_000, 1 << 19

_RUN = re.compile(f"[a-zÀ-ÿ]{{{MIN_LENGTH},}}")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_VALUE = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x2545F4914F6CDD1D))


def counted(docs: DataFrame) -> DataFrame:
    """(word, n): runs of letters of all texts, A-Z lower-cased, at least MIN_LENGTH long, counted; some lose a character, by document.

    A null id counts as an empty one."""

    def result(run: str, base: int) -> str:
        h = zlib.crc32(run.encode(), base)
        if h % ODDS:
            return run
        k = h % len(run)
        return run[:k] + run[k + 1 :]

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in parts_of(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                base = zlib.crc32(f"{doc or ''}:".encode())
                runs = Counter(_RUN.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                for own, n in runs.items():
                    counts[result(own, base)] += n
            if len(counts) >= COUNTED:
                yield batch_of(counts)
                counts.clear()
        yield batch_of(counts)

    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return rows.filter(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.sum("n").alias("n"))


class Filters:
    """Where the blocks of some lengths lie. part: of a length divided by hash into `parts`, the one at hand."""

    def __init__(self, words: dict[int, int], parts: int = 1, part: int = 0) -> None:
        self.parts, self.part = parts, part
        self.blocks, self.first = np.zeros(LONGEST + 1, np.uint64), np.zeros(LONGEST + 1, np.int64)
        for length, n in sorted(words.items()):
            self.first[length] = self.blocks.sum()
            self.blocks[length] = max(1, -(-n * WORD_BYTES // (8 * parts)))
        self.size = int(self.blocks.sum())

    def place(self, z: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Block and bits of hashes of words of one length."""
        bits = np.zeros(len(z), np.uint64)
        for k in range(BITS):
            bits |= np.uint64(1) << (z >> np.uint64(6 * k) & np.uint64(63))
        return ((z >> np.uint64(32)) % self.blocks[length]).astype(np.int64) + self.first[length], bits

    def mine(self, z: np.ndarray) -> np.ndarray:
        return (z >> np.uint64(24)) % np.uint64(self.parts) == self.part if self.parts > 1 else np.ones(len(z), bool)


def passes(words: dict[int, int], most: int) -> list[Filters]:
    """Filters for all lengths (with their counts of words), in groups of at most so many bytes."""
    out, held = [], {}
    for length, n in sorted(words.items()):
        if n * WORD_BYTES > most:
            parts = -(-n * WORD_BYTES // most)
            out += [Filters({length: n}, parts, p) for p in range(parts)]
        else:
            if (sum(held.values()) + n) * WORD_BYTES > most:
                out.append(Filters(held))
                held = {}
            held[length] = n
    return [*out, Filters(held)] if held else out


def _shard(length: int) -> int:
    return min(length, LONGEST)


def _powers(n: int) -> np.ndarray:
    x = np.full(n, _BASE, np.uint64)
    x[:1] = 1
    return np.cumprod(x, dtype=np.uint64)


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length (words x length)."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def _by_length(words: list[str]) -> Iterator[tuple[int, list[str]]]:
    words = sorted(words, key=len)
    a = 0
    while a < len(words):
        length, b = len(words[a]), a
        while b < len(words) and len(words[b]) == length and (b - a + 1) * length <= max(PROBES, length):
            b += 1
        yield length, words[a:b]
        a = b


def hashes(codes: np.ndarray) -> np.ndarray:
    return mix((_VALUE[codes] * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64))


def edits(words: list[str], length: int, alphabet: np.ndarray, replace: bool, delete: bool) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes, length, rows, places and characters (-1: deleted) of the edits of words of one length, PROBES or so at once.

    Deletions give each result once, though letters repeat; replacements are by a greater character only."""
    codes = _codes(words)
    power = _powers(length)
    value = _VALUE[codes]
    running = np.zeros((len(words), length + 1), np.uint64)
    np.cumsum(value * power, axis=1, out=running[:, 1:])
    total = running[:, -1]
    if delete:
        row, at = np.nonzero(np.append(codes[:, 1:] != codes[:, :-1], np.ones((len(words), 1), bool), axis=1))
        for a in range(0, len(row), PROBES):
            r, i = row[a : a + PROBES], at[a : a + PROBES]
            yield mix(running[r, i] + (total[r] - running[r, i + 1]) * _INVERSE), length - 1, r, i, np.full(len(i), -1)
    if replace:
        step = max(1, PROBES // (len(words) * len(alphabet)))
        for i in range(0, length, step):
            row, at, c = np.nonzero(alphabet > codes[:, i : i + step, None])
            at += i
            yield mix(total[row] + (_VALUE[alphabet[c]] - value[row, at]) * power[at]), length, row, at, alphabet[c]


def edited(word: str, i: int, c: int) -> str:
    """A word with the character c in place i, or with none there where c is -1."""
    return word[:i] + (chr(c) if c >= 0 else "") + word[i + 1 :]


def _filled(words: DataFrame, filters: Filters) -> np.ndarray:
    """The blocks of the filters, made in tasks and laid together by block; their size is bounded by FILTER_BYTES."""
    lengths = np.flatnonzero(filters.blocks).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            for length, own in _by_length(batch.column("word").to_pylist()):
                z = hashes(_codes(own))
                z = z[filters.mine(z)]
                block, bits = filters.place(z, _shard(length))
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(bits.view(np.int64))], names=["block", "bits"])

    some = words.filter(F.least(F.length("word"), F.lit(LONGEST)).isin(lengths)).select("word").mapInArrow(run, "block long, bits long")
    out = np.zeros(filters.size, np.uint64)
    for batch in some.groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow().to_batches():
        out[batch.column("block").to_numpy()] = batch.column("bits").to_numpy().view(np.uint64)
    return out


def _probed(words: DataFrame, filters: Filters, filled: np.ndarray, alphabet: np.ndarray) -> DataFrame:
    """(word, n, other): the edits of words (word, n) that the filters let pass."""
    shared = words.sparkSession.sparkContext.broadcast(filled)
    there = filters.blocks > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value
        for batch in parts_of(batches):
            n_of = dict(zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()))
            for length, own in _by_length(list(n_of)):
                replace, delete = bool(there[_shard(length)]), length > MIN_LENGTH and bool(there[_shard(length - 1)])
                for z, new_length, row, at, c in edits(own, length, alphabet, replace, delete):
                    if filters.parts > 1:
                        held = filters.mine(z)
                        z, row, at, c = z[held], row[held], at[held], c[held]
                    block, bits = filters.place(z, _shard(new_length))
                    hit = np.flatnonzero(blocks[block] & bits == bits)
                    if len(hit):
                        pairs = [(own[r], edited(own[r], i, x)) for r, i, x in zip(row[hit].tolist(), at[hit].tolist(), c[hit].tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs]), pa.array([n_of[a] for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs])], names=["word", "n", "other"])

    lengths = np.flatnonzero(there | np.append(np.zeros(1, bool), there[:-1])).tolist() + ([LONGEST] if there[LONGEST] else [])
    some = words.filter(F.least(F.length("word"), F.lit(LONGEST)).isin(lengths))
    return some.mapInArrow(run, "word string, n long, other string")


def near_pairs(words: DataFrame, most: int = FILTER_BYTES) -> DataFrame:
    """(word, n, other, other_n): each pair of words (word, n) that differ by exactly one character, once. A word stands in one row of words.

    most: bytes of the filters that are broadcast together."""
    spark = words.sparkSession
    ship(spark)
    lengths = dict(words.groupBy(F.least(F.length("word"), F.lit(LONGEST)).alias("length")).count().collect())  # LONGEST rows at most
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().collect()  # an alphabet's
    alphabet = np.array(sorted(ord(r[0]) for r in letters if r[0]), np.int64)
    dealt = words.repartition(max(1, sum(lengths.values()) // TASK_WORDS), "word")
    other = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    found = spark.createDataFrame([], "word string, n long, other string")
    for filters in passes(lengths, most):
        found = found.unionByName(_probed(dealt, filters, _filled(words, filters), alphabet))
    return found.join(other, "other").select("word", "n", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where following forms ends. Each form is RATIO times as frequent as its word, so ways are short
    and have no circle; every round doubles the steps taken."""
    at = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialize(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        discard(at)
        moved = not step.filter("moved").isEmpty()
        at = step
        if not moved:
            return at.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of docs (doc_id, text; other columns are left out).

    Null and empty texts have no words; repeated rows count as often as they stand. Of near words of equal count the
    smallest in code-point order is the form. An empty table gives no rows."""
    words = materialize(counted(docs).filter(F.col("n") >= MIN_COUNT))
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(
        F.struct("word", "n", F.col("other").alias("near"), F.col("other_n").alias("near_n")),
        F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")),
    )).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("top"))
    best = materialize(best.select("word", "n_near", "top.near", (-F.col("top.less")).alias("near_n")))
    out = words.join(best, "word", "left").withColumn("_fits", F.coalesce(F.col("near_n") >= RATIO * F.col("n"), F.lit(False)))
    out = out.select("word", F.when(F.col("_fits"), F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("_fits"), F.col("near_n")).alias("form_n"))
    out = materialize(out)
    discard(words, best)
    ends = roots(out.filter("form is not null"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
