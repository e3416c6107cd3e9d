"""Exact ranked lexical search: the best documents of each query item by inner product, through ball trees over sparse vectors.

A document's vector holds, for each term of the items, the whole number (1000000000 tf) div (1000 tf + 20 m); an item's vector
holds the weights of its terms. Documents come in chunks of CHUNK; each chunk is a tree split at the median along the line
between two far documents. A node keeps its documents' centroid c and, in each of GROUPS groups of terms, the radius r: the greatest
length of what a document has above the centroid. Vectors have no negative part, so an inner product with q is at most q.c + sum |q| r,
rounded up. For each item nodes are opened best first and dropped once their bound is under the item's
least kept score; leaves are scored in 64-bit integers. A floor for each item's score, from a bounded number of documents, is
known before all documents are searched; it leaves out nothing that belongs to the result."""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codonweave.llm.common import encode, parts_of
from codonweave.session import discard, materialize, ship

TOP = 50
#: Documents of a tree, and of a leaf.
CHUNK, LEAF = 2048, 8
#: Groups of terms with a radius of their own; the most frequent terms are groups by themselves, and all are where they are no more.
#: Measured on 10,000 texts and 200 items: 64 groups leave out no leaf, 4,096 leave out two thirds.
GROUPS = 4096
#: Items and their terms that are searched together, and items and characters of a pass over the documents.
BLOCK_ITEMS, BLOCK_TERMS, PASS_ITEMS, PASS_CHARS = 512, 8192, 20_000, 8_000_000
#: About so many documents give the floors.
FLOOR_ROWS = 50_000
#: What bounds are multiplied with, far over the rounding of a sum of 10^6 doubles.
SAFE = 1 + 1e-9

_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII digits and letters and of characters beyond ASCII, A-Z lower-cased."""
    return _TERM.findall(encode(text).lower())


def vectors(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, n (terms with repeats), at and tf (ascending numbers of the given terms in the text, and their counts) of each row with a term."""
    number = {t: k for k, t in enumerate(terms)}
    known = number.keys()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            n, at, tf, size = [], [], [], []
            for text in batch.column("text").to_pylist():
                words = terms_of(text)
                counts = Counter(words)
                held = sorted((number[t], counts[t]) for t in counts.keys() & known)
                n.append(len(words))
                size.append(len(held))
                at += [a for a, _ in held]
                tf += [c for _, c in held]
            ends = pa.array(np.cumsum([0, *size]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (at, tf)]
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "at", "tf"])
            yield out.filter(pa.array(np.array(n, np.int64) > 0))

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, at array<int>, tf array<int>")


class Block:
    """Some items that are searched together: the numbers of their terms, the terms' groups, and each item's weights.

    of: by item its terms' places in `terms`, their weights, its groups and the length of its weights in each."""

    def __init__(self, items: list[tuple[int, list[int]]], weight: np.ndarray, df: np.ndarray) -> None:
        self.terms = np.unique(np.concatenate([np.array(t, np.int64) for _, t in items]))
        width = len(self.terms)
        self.groups = min(GROUPS, width)
        alone = width if width <= GROUPS else GROUPS * 3 // 4
        self.group = alone + np.arange(width) % max(1, GROUPS - alone)
        self.group[np.argsort(-df[self.terms], kind="stable")[:alone]] = np.arange(alone)
        self.of = {}
        for k, t in items:
            at, w = np.searchsorted(self.terms, t), weight[t]
            group, of = np.unique(self.group[at], return_inverse=True)
            self.of[k] = at, w, group, np.sqrt(np.bincount(of, weights=w.astype(float) ** 2))


def blocks_of(items: list[tuple[int, list[int]]], weight: np.ndarray, df: np.ndarray) -> list[Block]:
    """Items (number, term numbers) in blocks of bounded size; an item alone may have more terms."""
    out, held, seen = [], [], set()
    for k, terms in items:
        if held and (len(held) == BLOCK_ITEMS or len(seen | set(terms)) > BLOCK_TERMS):
            out.append(Block(held, weight, df))
            held, seen = [], set()
        held.append((k, terms))
        seen |= set(terms)
    return [*out, Block(held, weight, df)] if held else out


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each row's size, one row after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Tree:
    """A ball tree over rows of (term, value) pairs; every row has a pair."""

    def __init__(self, term: np.ndarray, value: np.ndarray, sizes: np.ndarray, block: Block) -> None:
        rows, width, groups = len(sizes), len(block.terms), block.groups
        starts = np.cumsum(sizes) - sizes
        x = value.astype(float)
        square = np.add.reduceat(x * x, starts)
        order = np.arange(rows)
        self.spans: list[tuple[int, int]] = [(0, rows)]
        self.children: list[int] = []  # the first of two; 0 in a leaf
        centers, radii = [], []
        k = 0
        while k < len(self.spans):
            lo, hi = self.spans[k]
            own = order[lo:hi]
            size = sizes[own]
            at = _spread(starts[own], size)
            t, v, first = term[at], x[at], np.cumsum(size) - size
            center = np.bincount(t, weights=v, minlength=width) / (hi - lo)
            radii.append(self._radii(np.repeat(np.arange(hi - lo), size) * groups + block.group[t], np.maximum(v - center[t], 0), groups))
            centers.append(center)
            if hi - lo <= LEAF:
                self.children.append(0)
            else:
                far = int(np.argmax(square[own] - 2 * np.add.reduceat(v * center[t], first)))
                line = self._dense(t, v, first, size, far, width)
                other = int(np.argmax(square[own] - 2 * np.add.reduceat(v * line[t], first)))
                line = line - self._dense(t, v, first, size, other, width)
                order[lo:hi] = own[np.argsort(np.add.reduceat(v * line[t], first), kind="stable")]
                mid = (lo + hi) // 2
                self.children.append(len(self.spans))
                self.spans += [(lo, mid), (mid, hi)]
            k += 1
        self.centers, self.radii, self.order = np.stack(centers, axis=1), np.stack(radii, axis=1), order
        self.sizes = sizes[order]
        self.starts = np.cumsum(self.sizes) - self.sizes
        at = _spread(starts[order], self.sizes)
        self.term, self.value = term[at], value[at]

    @staticmethod
    def _dense(t: np.ndarray, v: np.ndarray, first: np.ndarray, size: np.ndarray, row: int, width: int) -> np.ndarray:
        own = slice(first[row], first[row] + size[row])
        return np.bincount(t[own], weights=v[own], minlength=width)

    @staticmethod
    def _radii(place: np.ndarray, above: np.ndarray, groups: int) -> np.ndarray:
        """By group, the greatest length of what a row has above the centroid. place: row times groups, and group."""
        at, of = np.unique(place, return_inverse=True)
        out = np.zeros(groups)
        np.maximum.at(out, at % groups, np.sqrt(np.bincount(of, weights=above * above)))
        return out

    def bounds(self, at: np.ndarray, weight: np.ndarray, group: np.ndarray, length: np.ndarray) -> np.ndarray:
        """By node, what no row of it can exceed in its score with an item."""
        return (weight.astype(float) @ self.centers[at] + length @ self.radii[group]) * SAFE + 1

    def scores(self, lo: int, hi: int, weight: np.ndarray) -> np.ndarray:
        """The whole-number scores of the rows from lo to hi, in the tree's order."""
        a, b = self.starts[lo], self.starts[hi - 1] + self.sizes[hi - 1]
        return np.add.reduceat(weight[self.term[a:b]] * self.value[a:b], self.starts[lo:hi] - a)


class Best:
    """The best rows of one item so far. least: no lower score belongs to the result."""

    def __init__(self, top: int, floor: int) -> None:
        self.top, self.least, self.held = top, max(1, floor), []

    def add(self, scores: np.ndarray, names: list) -> None:
        self.held += [(-s, d is None, d) for s, d in zip(scores.tolist(), names)]
        if len(self.held) >= 4 * self.top:
            self.cut()

    def cut(self) -> None:
        self.held.sort()
        del self.held[self.top :]
        if len(self.held) == self.top:
            self.least = max(self.least, -self.held[-1][0])


def search(tree: Tree, block: Block, best: dict[int, Best], names: list) -> int:
    """Open the tree for each item of the block, best node first; the number of rows that were scored."""
    scored = 0
    weights = np.zeros(len(block.terms), np.int64)
    for k, (at, weight, group, length) in block.of.items():
        mine, bound = best[k], tree.bounds(at, weight, group, length).tolist()
        weights[at] = weight
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] >= mine.least:
            _, node = heapq.heappop(heap)
            if child := tree.children[node]:
                for c in (child, child + 1):
                    if bound[c] >= mine.least:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            lo, hi = tree.spans[node]
            scored += hi - lo
            s = tree.scores(lo, hi, weights)
            good = np.flatnonzero(s >= mine.least)
            if len(good):
                mine.add(s[good], [names[i] for i in tree.order[lo + good].tolist()])
        weights[at] = 0
    return scored


def impacts(n: np.ndarray, tf: np.ndarray, many: int, total: int) -> np.ndarray:
    """What a term that occurs tf times counts in a text of n terms, of `many` texts with `total` terms; all in 64-bit integers."""
    m = 50 + 50 * n * many // total
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def _searched(table: DataFrame, blocks: list[Block], many: int, total: int, floors: dict[int, int], top: int) -> DataFrame:
    """(item, doc_id, score): of each task's documents those that can be among the best."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, rows = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                held.append(batch.slice(a, CHUNK))
                rows += held[-1].num_rows
                if rows >= CHUNK:
                    yield pa.Table.from_batches(held)
                    held, rows = [], 0
        if rows:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {k: Best(top, floors.get(k, 1)) for b in blocks for k in b.of}
        kind = None
        for chunk in chunks(batches):
            chunk = chunk.combine_chunks()
            kind = chunk.schema.field("doc_id").type
            names = chunk.column("doc_id").to_pylist()
            sizes = np.diff(chunk.column("at").combine_chunks().offsets.to_numpy()).astype(np.int64)
            at = chunk.column("at").combine_chunks().flatten().to_numpy().astype(np.int64)
            tf = chunk.column("tf").combine_chunks().flatten().to_numpy().astype(np.int64)
            value = impacts(np.repeat(chunk.column("n").to_numpy(), sizes), tf, many, total)
            row = np.repeat(np.arange(len(sizes)), sizes)
            for block in blocks:
                place = np.minimum(np.searchsorted(block.terms, at), len(block.terms) - 1)
                mine = block.terms[place] == at
                per = np.bincount(row[mine], minlength=len(sizes))
                there = np.flatnonzero(per)
                if len(there):
                    tree = Tree(place[mine], value[mine], per[there], block)
                    search(tree, block, best, [names[i] for i in there.tolist()])
        for k, b in best.items():
            b.cut()
            if b.held:
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(b.held), pa.int64()), pa.array([d for _, _, d in b.held], kind), pa.array([-s for s, _, _ in b.held], pa.int64())], names=["item", "doc_id", "score"])

    kind = table.schema["doc_id"].dataType.simpleString()
    return table.mapInArrow(run, f"item long, doc_id {kind}, score long")


def _passes(items: DataFrame) -> Iterator[list[tuple]]:
    """Rows (item_id, text) of items in lists of bounded size, through the driver one after another."""
    held, chars = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        held.append((row[0], row[1]))
        chars += len(row[1] or "")
        if len(held) >= PASS_ITEMS or chars >= PASS_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, floor_rows: int = FLOOR_ROWS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the rows of docs of highest score above 0 for each row of items; all, if there are fewer than top.

    Equal scores stand by ascending doc_id, null ids last. Null and empty texts, of either table, have no terms and
    give nothing; repeated rows of docs rank one after another, repeated items each have their own rows. Other
    columns are left out; an empty table gives no rows. Items beyond PASS_ITEMS or PASS_CHARS are searched in a further pass."""
    spark = docs.sparkSession
    doc_kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (items, "item_id")))
    out = spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {doc_kind}, score long")
    for rows in _passes(items):
        wanted = [sorted(set(terms_of(text))) for _, text in rows]
        terms = sorted({t for ts in wanted for t in ts})
        if not terms:
            continue
        number = {t: k for k, t in enumerate(terms)}
        table = materialize(vectors(docs, terms))
        many, total = table.agg(F.count("*"), F.sum("n")).first()
        if not many:
            discard(table)
            continue
        df = np.zeros(len(terms), np.int64)
        for at, c in table.select(F.explode("at").alias("at")).groupBy("at").count().collect():  # a row for each term of this pass at most
            df[at] = c
        weight = np.array([math.floor(1000 * math.log((2 * many + 2) / (2 * c + 1))) for c in df.tolist()], np.int64)
        blocks = blocks_of([(k, [number[t] for t in ts]) for k, ts in enumerate(wanted) if ts], weight, df)
        full = table.filter(F.size("at") > 0)
        floors: dict[int, int] = {}
        part = many // floor_rows
        if part > 1:
            some = full.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(part)) == 0)
            least = _best(_searched(some, blocks, many, total, {}, top), top).groupBy("item").agg(F.min("score"), F.count("*"))
            floors = {k: s for k, s, c in least.collect() if c == top}
        found = materialize(_best(_searched(full, blocks, many, total, floors, top), top))
        discard(table)
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(rows)], f"item long, item_id {item_kind}")
        out = out.unionByName(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out


def _best(found: DataFrame, top: int) -> DataFrame:
    """The first rows of each item, with their rank."""
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top)
