"""Quality rules: repetition inside a text, from a suffix array over its words.

The suffix array of a batch is built by prefix doubling over word ids, in which texts never meet.
Longest common prefixes of neighbouring suffixes come from the ranks of the doubling rounds. A
suffix whose neighbour shares l words opens a repeat of l words; these are the maximal repeated
substrings of the LCP intervals. Their spans are united, and a text is rejected when
the union covers too large a part of its words or the longest repeat is too long."""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codonweave.llm.common import encode, filter_rows, map_rows

if TYPE_CHECKING:
    import pandas as pd

#: Shortest repeat, in words, that counts as covered; the part of the words, in hundredths, that may be covered; the longest repeat allowed.
MIN_REPEAT, MAX_COVERED, MAX_REPEAT = 10, 15, 50
#: Words whose suffix array is built at once; a longer text is taken alone.
WORDS_AT_ONCE = 150_000
_WHITE = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long"


def repeat_lengths(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each position the longest run of words from there that also starts elsewhere in its text.

    ids: word ids of several texts one after another; starts: where each text begins."""
    n = len(ids)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    ends = np.append(starts[1:], n)
    end_of = np.repeat(ends, ends - starts)
    text_of = np.repeat(np.arange(len(starts), dtype=np.int64), ends - starts)
    key = text_of * (int(ids.max()) + 1) + ids
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    slots = np.arange(n)
    rank = np.empty(n, np.int32 if n < 1 << 31 else np.int64)
    levels: list[np.ndarray] = []
    h = 1
    while True:
        # slots: the places in sa that are not settled; ordered: their keys, sorted
        first = np.ones(len(slots), bool)
        first[1:] = ordered[1:] != ordered[:-1]
        head = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        rank[sa[slots]] = head
        levels.append(rank.copy())
        last = np.ones(len(slots), bool)
        last[:-1] = first[1:]
        slots = slots[~(first & last)]
        if not len(slots):
            break
        at = sa[slots]
        then = at + h
        inside = then < end_of[at]
        follow = np.zeros(len(at), np.int64)
        follow[inside] = rank[then[inside]].astype(np.int64) + 1
        ordered = rank[at].astype(np.int64) * (n + 1) + follow
        order = np.argsort(ordered, kind="stable")
        sa[slots] = at[order]
        ordered = ordered[order]
        h *= 2
    a, b = sa[:-1], sa[1:]
    pair = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[pair], b[pair]
    lcp = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        ok = (x < end_of[a]) & (y < end_of[b])
        same = np.zeros(len(a), bool)
        same[ok] = levels[k][x[ok]] == levels[k][y[ok]]
        lcp[same] += 1 << k
    np.maximum.at(best, a, lcp)
    np.maximum.at(best, b, lcp)
    return best


def covered(best: np.ndarray, shortest: int) -> np.ndarray:
    """Which positions lie in a repeat of at least so many words."""
    edge = np.zeros(len(best) + 1, np.int64)
    at = np.flatnonzero(best >= shortest)
    edge[at] += 1
    np.add.at(edge, at + best[at], -1)
    return np.cumsum(edge[:-1]) > 0


def _measure(texts: list[str | None], min_repeat: int) -> np.ndarray:
    out = np.zeros((len(texts), 7), np.int64)
    words: list[bytes] = []
    lengths, begun = [], 0

    def flush(upto: int) -> None:
        nonlocal begun
        count = np.array(lengths, np.int64)
        if len(words):
            number = defaultdict(itertools.count().__next__)
            ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            starts = np.concatenate(([0], np.cumsum(count)[:-1]))
            full = count > 0
            best = repeat_lengths(ids, starts[full])
            where = np.flatnonzero(full) + begun
            for col, seen in ((4, covered(best, 5)), (5, covered(best, min_repeat))):
                out[where, col] = np.add.reduceat(seen.astype(np.int64), starts[full])
            out[where, 6] = np.maximum.reduceat(best, starts[full])
        words.clear()
        lengths.clear()
        begun = upto

    for i, text in enumerate(texts):
        raw = encode(text)
        own = raw.split()
        if words and len(words) + len(own) > WORDS_AT_ONCE:
            flush(i)
        words += own
        lengths.append(len(own))
        bare = raw.translate(None, _WHITE)
        lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
        out[i, 0] = len(own)
        out[i, 1] = len(text or "") - (len(raw) - len(bare))
        out[i, 2] = len(raw) - len(raw.translate(None, _SYMBOLS))
        out[i, 3] = len(lines) - len(set(lines))
    flush(len(texts))
    return out


def measure(docs: DataFrame, text: str = "text", min_repeat: int = MIN_REPEAT) -> DataFrame:
    """docs with the columns of SCHEMA, in place of columns of those names in any case, should docs have any.

    Null and empty texts have no words and zeros everywhere. Repeated rows are measured one by one; an empty table gives no rows."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    if text.lower() in names:
        raise ValueError(f"the text column must not be called {text}")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for pdf in batches:
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(_measure(list(pdf[text]), min_repeat), columns=names)], axis=1)

    return map_rows(docs, run, StructType(docs.schema.fields + StructType.fromDDL(SCHEMA).fields))


def verdict(measured: DataFrame, max_covered: int = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Adds base_failed (fewer than 10 words, or over 20 % of words in repeated 5-word windows) and kept."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    good = (100 * F.col("covered_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_repeat)
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & good)


def quality(docs: DataFrame, **limits: int) -> DataFrame:
    """doc_id, the measures and the verdict of every text, one row per row of docs; null and empty texts fail."""
    order = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat")
    return verdict(measure(docs.select("doc_id", "text")), **limits).select(*order)


def keep_good(docs: DataFrame, max_covered: int = MAX_COVERED, max_repeat: int = MAX_REPEAT, min_repeat: int = MIN_REPEAT) -> DataFrame:
    """The rows of docs whose text passes, with all columns of docs as they are.

    Null and empty texts go; of repeated rows all stay or all go. An empty table stays empty."""

    def passes(texts: list[str | None]) -> np.ndarray:
        n_words, _, _, _, repeat, cover, longest = _measure(texts, min_repeat).T
        return (n_words >= 10) & (100 * repeat <= 20 * n_words) & (100 * cover <= max_covered * n_words) & (longest <= max_repeat)

    return filter_rows(docs, passes)
