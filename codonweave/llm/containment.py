"""Size-partitioned MinHash containment search: short items inside long texts.

Items are partitioned by length in shingles. For a class of items of at most L shingles a text is cut
into overlapping windows, a fourth of L apart, such that every stretch of L shingles lies whole in
one. A containment c of an item of q shingles in a window of W means a Jaccard similarity of
c q / (q + W - c q) at least; the class has as many one-row bands as bring the chance to miss its
smallest item below MISS. A window and an item that agree on a band are a candidate, and the exact share of the item's
shingles that the whole text holds decides. A one-row band can only agree where the window's least
shingle is an item's, so windows without any shingle of an item are left out beforehand. An item of fewer than k words is
one shingle of its own length, so it is held where its words stand one after another.

The items are taken in blocks of bounded size; a block's index goes to every task, where each text is cut,
searched and verified, so texts are never shuffled."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonweave.llm.common import filter_rows, lower_words, map_rows, mix, shingles

if TYPE_CHECKING:
    import pandas as pd

#: Least share of an item's shingles, in hundredths.
CONTAINED = 75
MISS = 1e-5
#: Items and characters of items in one block.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 8_000_000
#: Shingles of a text that are searched at once.
STRETCH = 65_536
_TOP = np.uint64(42)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)

Words = Callable[[str | None], list[bytes]]


def size_class(n: int) -> tuple[int, int]:
    """(smallest, largest) length of the class that holds n shingles; the largest are 2^k and 3 * 2^k."""
    below, top = 0, 1
    while top < n:
        below, top = top, (top * 3 // 2 if top & (top - 1) == 0 and top > 1 else top * 4 // 3 if top > 1 else 2)
    return below + 1, top


def bands(smallest: int, window: int, contained: int = CONTAINED, miss: float = MISS) -> int:
    """Bands of one row that bring the chance to miss an item of the class below miss."""
    shared = max(1, math.ceil(contained * smallest / 100))
    j = shared / (smallest + window - shared)
    return 1 if j >= 1 else math.ceil(math.log(miss) / math.log1p(-j))


class Index:
    """What a task needs to find items of one shingle length."""

    def __init__(self, items: list[tuple[int, np.ndarray]], contained: int) -> None:
        """items: number and shingles in order of each."""
        self.contained = contained
        self.sets = {k: np.unique(s) for k, s in items}
        self.known = np.unique(np.concatenate([*self.sets.values(), np.empty(0, np.uint64)]))
        self.classes = []
        by: dict[tuple[int, int], list[int]] = {}
        for k, s in items:
            by.setdefault(size_class(len(s)), []).append(k)
        for (smallest, largest), ids in sorted(by.items()):
            step = max(1, largest // 4)
            blocks = -(-(largest + step - 1) // step)
            n = bands(smallest, blocks * step, contained)
            a = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
            keys = np.array([(self.sets[k][None, :] * a[:, None]).min(axis=1) for k in ids])
            tagged = (keys + np.arange(n, dtype=np.uint64)[None, :] * np.uint64(0xC2B2AE3D27D4EB4F)).ravel()
            order = np.argsort(tagged)
            self.classes.append((step, blocks, a, tagged[order], np.repeat(np.array(ids), n)[order]))

    def table(self) -> np.ndarray:
        """Marks the leading bits of all shingles of items."""
        seen = np.zeros(1 << (64 - int(_TOP)), bool)
        seen[self.known >> _TOP] = True
        return seen

    def find(self, h: np.ndarray, table: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, shared shingles, place of the first, place of the last) of the items in a text."""
        where = np.flatnonzero(table[h >> _TOP])
        if len(where):
            at = np.searchsorted(self.known, h[where])
            where = where[self.known[np.minimum(at, len(self.known) - 1)] == h[where]]
        if not len(where):
            return []
        hit: set[int] = set()
        for step, blocks, a, keys, ids in self.classes:
            wide = step * blocks
            begin, end = max(0, int(where[0]) - wide) // step * step, int(where[-1]) + wide
            for at in range(begin, min(end, max(1, len(h) - wide + 1)), STRETCH // step * step):
                part = h[at : min(at + STRETCH + wide, end)]
                n = -(-len(part) // step)
                v = np.full((len(a), n * step), _FULL)
                np.multiply(part[None, :], a[:, None], out=v[:, : len(part)])
                v = v.reshape(len(a), n, step).min(axis=2) if step > 1 else v
                low = v.copy()
                for i in range(1, min(blocks, n)):
                    np.minimum(low[:, : n - i], v[:, i:], out=low[:, : n - i])
                tagged = np.unique(low + np.arange(len(a), dtype=np.uint64)[:, None] * np.uint64(0xC2B2AE3D27D4EB4F))
                x, y = np.searchsorted(keys, tagged, "left"), np.searchsorted(keys, tagged, "right")
                for i, j in zip(x[x < y], y[x < y]):
                    hit.update(ids[i:j].tolist())
        found = []
        if hit:
            own = np.unique(h)
            for k in sorted(hit):
                s = self.sets[k]
                shared = int(np.isin(s, own, assume_unique=True).sum())
                if 100 * shared >= self.contained * len(s):
                    where = np.flatnonzero(np.isin(h, s))
                    found.append((k, shared, int(where[0]), int(where[-1])))
        return found


class Block:
    """A block of items: an index for each shingle length that they need, and their keys."""

    def __init__(self, items: list[tuple[object, int, list[bytes]]], k: int, contained: int) -> None:
        """items: key, copies and words of each, at least one word."""
        self.names, self.copies = [name for name, _, _ in items], [copies for _, copies, _ in items]
        self.indexes = {}
        for size in sorted({min(k, len(w)) for _, _, w in items}):
            self.indexes[size] = Index([(j, shingles(w, size)) for j, (_, _, w) in enumerate(items) if min(k, len(w)) == size], contained)
        self.tables: dict[int, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": {}}  # 4 MB each, made where they are used

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
        """(item, its shingles, shared ones, first word, last word) of the items in a text."""
        for size, index in self.indexes.items():
            if size not in self.tables:
                self.tables[size] = index.table()
            for j, n, a, b in index.find(shingles(words, size), self.tables[size]):
                yield j, len(index.sets[j]), n, a, b + size - 1


def _blocks(items: DataFrame, key: str, words: Words, k: int, contained: int) -> Iterator[Block]:
    """Blocks of bounded size of the items that have words; equal rows are one item with a number of copies."""
    own = items.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text")).filter("text is not null")
    own = own.groupBy("key", "text").agg(F.count("*").alias("copies"))
    count, chars = own.agg(F.count("*"), F.sum(F.length("text"))).first()
    parts = max(1, -(-count // BLOCK_ITEMS), -(-(chars or 0) // BLOCK_CHARS))
    for i in range(parts):
        rows = own.filter(F.pmod(F.xxhash64("key", "text"), F.lit(parts)) == i).collect()
        split = [(r["key"], r["copies"], words(r["text"])) for r in rows]
        yield Block([(x, n, w) for x, n, w in split if w], k, contained)


def search(docs: DataFrame, items: DataFrame, key: str, words: Words = lower_words, k: int = 5, contained: int = CONTAINED) -> DataFrame:
    """doc_id, key, n_item, n_shared, first_word, last_word: the items that each text holds.

    docs: columns doc_id and text, others are left out; items: columns key and text. An item is held if at least contained
    hundredths of its distinct k-word shingles occur in the text; one of fewer words if they all occur in a row. Items without
    words are held by no text; null and empty texts hold none. Repeated rows of docs
    and of items bring repeated rows. An empty table on either side gives no rows."""
    spark, kind = docs.sparkSession, items.schema[key].dataType.simpleString()
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key {kind}, n_item long, n_shared long, first_word long, last_word long"
    out = None
    for block in _blocks(items, key, words, k, contained):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            import pandas as pd

            block = shared.value
            for pdf in batches:
                rows = []
                for doc, text in zip(pdf["doc_id"], pdf["text"]):
                    for j, *found in block.find(words(text)):
                        rows += [(doc, block.names[j], *found)] * block.copies[j]
                yield pd.DataFrame(rows, columns=["doc_id", "key", "n_item", "n_shared", "first_word", "last_word"])

        found = map_rows(docs.select("doc_id", "text"), run, schema)
        out = found if out is None else out.unionAll(found)
    return out.withColumnRenamed("key", key)


def without(docs: DataFrame, items: DataFrame, words: Words = lower_words, k: int = 5, contained: int = CONTAINED) -> DataFrame:
    """The rows of docs that hold none of the items, as search() finds them, with all their columns.

    Null and empty texts stay, of repeated rows all or none; with no items docs stays as it is. One block of items is searched
    as the rows pass by. More blocks each look over the texts by themselves and name those that hold an item, by two hashes
    and the length; the rows are filtered once, so no task has more than one block and one worker."""
    spark = docs.sparkSession
    blocks = _blocks(items.select(F.lit(0).alias("key"), "text"), "key", words, k, contained)
    shared = [spark.sparkContext.broadcast(block) for block in blocks]

    def holding(one, held: bool):
        return lambda texts: [(next(one.value.find(words(t)), None) is not None) == held for t in texts]

    if len(shared) == 1:
        return filter_rows(docs, holding(shared[0], False))
    name = [F.xxhash64("text").alias("_h1"), F.hash("text").alias("_h2"), F.length("text").alias("_n")]
    found = None
    for one in shared:
        own = filter_rows(docs.select("text").filter("text is not null"), holding(one, True)).select(*name)
        found = own if found is None else found.unionAll(own)
    found = found.distinct()
    same = [(F.xxhash64(docs["text"]) == found["_h1"]) & (F.hash(docs["text"]) == found["_h2"]) & (F.length(docs["text"]) == found["_n"])]
    return docs.join(found, same, "left_anti")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, first_word, last_word: benchmark items found inside documents, as search() does."""
    return search(docs, benchmark, "item_id")
