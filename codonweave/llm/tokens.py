"""Token counts under a unigram vocabulary, with one forward pass per shared prefix of a trie.

The pieces are those of a public byte vocabulary; a piece of rank r has the Zipf probability
proportional to 1 / (r + 1). A pre-token's count is that of its likeliest segmentation, of the
fewest pieces among equals. The distinct pre-tokens of a batch are inserted in a trie, which sorting walks depth
first: forward scores of a prefix are computed once and kept while the walk stays
below it, and the count at each terminal is stored for all its occurrences."""

from __future__ import annotations

import base64
import functools
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from codonweave.llm.common import map_rows

#: Scores are whole numbers of this part of a nat, so that equal sums are equal.
SCALE = 1 << 20
#: Pre-tokens whose counts a worker keeps before it starts anew.
KEPT = 600_000


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> dict[bytes, int]:
    """The score of each piece of a .tiktoken file."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    norm = math.log(math.fsum(1 / (r + 1) for r in ranks.values()))
    return {p: round(-SCALE * (math.log(r + 1) + norm)) for p, r in ranks.items()}


@functools.lru_cache(maxsize=2)
def longest_piece(path: str) -> int:
    return max(map(len, pieces(path)))


def trie_counts(words: list[bytes], scores: dict[bytes, int], longest: int | None = None) -> dict[bytes, int]:
    """The number of pieces of each word. Every single byte must be a piece; longest: bytes of the longest one."""
    longest = longest or max(map(len, scores), default=1)
    counts: dict[bytes, int] = {}
    best: list[tuple[int, int]] = [(0, 0)]  # by prefix length: score and minus the pieces
    before = b""
    for word in sorted(set(words)):
        shared, most = 0, min(len(word), len(before))
        while shared < most and word[shared] == before[shared]:
            shared += 1
        del best[shared + 1 :]
        for j in range(shared + 1, len(word) + 1):
            top = None
            for i in range(max(0, j - longest), j):
                s = scores.get(word[i:j])
                if s is not None:
                    way = (best[i][0] + s, best[i][1] - 1)
                    if top is None or way > top:
                        top = way
            best.append(top)
        counts[word] = -best[len(word)][1]
        before = word
    return counts


@functools.lru_cache(maxsize=1)
def _pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


_counts: dict[str, dict[str, int]] = {}


def count_texts(texts: list[str | None], path: str) -> list[tuple[int, int]]:
    """(pre-tokens, tokens) of each text."""
    known = _counts.setdefault(path, {})
    if len(known) > KEPT:
        known.clear()
    split = [_pattern().findall(t or "") for t in texts]
    new = {w for s in split for w in s if w not in known}
    if new:
        raw = {w: w.encode("utf-8", "surrogatepass") for w in new}
        found = trie_counts(list(raw.values()), pieces(path), longest_piece(path))
        known.update((w, found[b]) for w, b in raw.items())
    return [(len(s), sum(map(known.__getitem__, s))) for s in split]


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every row of docs. Null and empty texts have none; repeated rows count alike.

    Of segmentations of equal score that of the fewest pieces counts. Other columns are left out; an empty table gives no rows."""
    path = path or vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame(count_texts(list(pdf["text"]), path), columns=["n_pretokens", "n_tokens"])
            out.insert(0, "doc_id", pdf["doc_id"])
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_pretokens long, n_tokens long")
