"""Secret scans: fixed patterns, and strings that a public vocabulary encodes badly.

Text of any language takes several characters a token; a random string takes fewer than two. Runs
of key characters with a low ratio are secrets unless they look like known digests,
UUIDs, numbers or identifiers whose parts the vocabulary encodes as words. Runs of fewer than 16 characters are not
tested: at 12 to 15 one in 120 made-up words of the test tables would be taken for a secret, from 16 on one in 300."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonweave.llm.common import map_rows, map_text

if TYPE_CHECKING:
    import pandas as pd

#: Fewer characters a token than this mark a random string; shorter runs than MIN_RUN are not tested.
MAX_RATIO, MIN_RUN = 2.0, 16
KINDS = ("assign", "access", "hex", "random")
MARK = "[SECRET]"
#: Characters that are encoded at once.
STRETCH = 4096

_ANY_CASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = re.compile(rf"""(?:{_ANY_CASE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}")
_KNOWN = re.compile(r"[0-9]+|(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_WORDY = re.compile(r"(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}|[0-9]{1,4})(?:[_/=+-]+(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}|[0-9]{1,4}))*[_/=+-]*")
_LETTERS = re.compile(r"[A-Za-z]+")


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    """The byte-pair encoding of a .tiktoken file, loaded once per worker."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _tokens(run: str, path: str) -> int:
    """Tokens of a run; very long ones are encoded in stretches."""
    return sum(len(encoding(path).encode_ordinary(run[a : a + STRETCH])) for a in range(0, len(run), STRETCH))


def _words(run: str, path: str, max_ratio: float) -> bool:
    """Whether every part of letters is one token or has more than max_ratio characters a token, as a lower-case word."""
    for part in _LETTERS.findall(run):
        n = _tokens(" " + part.lower(), path)
        if n > 1 and len(part) <= max_ratio * n:
            return False
    return True


def is_random(run: str, path: str, max_ratio: float = MAX_RATIO) -> bool:
    """Whether a run of key characters is a random string."""
    if _KNOWN.fullmatch(run) or len(run) >= max_ratio * _tokens(run, path):
        return False
    return not (_WORDY.fullmatch(run) and _words(run, path, max_ratio))


def spans(text: str | None, path: str, max_ratio: float = MAX_RATIO) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind."""
    if not text:
        return []
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    at = 0
    for word in text.split():
        if len(word) < MIN_RUN:  # no kind is shorter
            continue
        at = text.index(word, at)
        found += [(at + m.start(), 1, at + m.end()) for m in _ACCESS.finditer(word)]
        found += [(at + m.start(), 2, at + m.end()) for m in _HEX.finditer(word)]
        found += [(at + m.start(), 3, at + m.end()) for m in _RUN.finditer(word) if is_random(m[0], path, max_ratio)]
        at += len(word)
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def secrets(docs: DataFrame, path: str | None = None, max_ratio: float = MAX_RATIO) -> DataFrame:
    """doc_id and spans array<struct<kind, start, end>> of every row of docs (columns doc_id and text).

    Null and empty texts have no spans. Each row is scanned alone, repeated ones too; other columns are left out. Spans
    that start together stand in the order of KINDS. An empty table gives no rows."""
    path = path or vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for pdf in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t, path, max_ratio)] for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "spans": found})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the pattern spans and all spans as text, from secrets(), row by row; without spans the
    counts are 0 and both texts empty."""

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(base: bool):
        own = F.filter("spans", lambda s: s["kind"] != KINDS[-1]) if base else F.col("spans")
        return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select("doc_id", *[count(k) for k in KINDS[:-1]], F.sha2(joined(True).cast("binary"), 256).alias("base_sha256"), joined(False).alias("spans"), count(KINDS[-1]))


def redact(docs: DataFrame, path: str | None = None, max_ratio: float = MAX_RATIO, mark: str = MARK) -> DataFrame:
    """docs with every secret in its texts replaced by mark; n_chars, if there, follows.

    Overlapping spans are replaced as one. All rows, also repeated ones, null texts and other columns stay as they are."""
    path = path or vocabulary()

    def clean(text: str | None) -> str | None:
        found = spans(text, path, max_ratio)
        if not found:
            return text
        parts, at, end = [], 0, -1
        for _, a, b in found:
            if a >= end:
                parts += [text[at:a] if end < 0 else text[end:a], mark]
                end = b
            end = max(end, b)
        return "".join(parts) + text[end:]

    out = map_text(docs, lambda texts: [clean(t) for t in texts])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
