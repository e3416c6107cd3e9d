"""Byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs.

The leaves of a pre-token's tree hold the merge rank and place of the pair that begins at each symbol, so the root is
the leftmost pair of lowest rank. A merge changes three leaves (the pair itself, the one before, the one that began at its
right symbol), each updated on its path to the root; the pre-token is done when no leaf can be merged.
The trees of all new pre-tokens of a batch are worked on together, one merge in each at a time; a pre-token over
BULK bytes has a tree of its own."""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codonweave.llm.common import parts_of
from codonweave.llm.packing import vocabulary
from codonweave.session import ship

#: Bytes up to which pre-tokens are merged together, and how many of them at once.
BULK, AT_ONCE = 64, 1 << 15
#: Stretches and pre-tokens whose ids a task keeps before it starts anew.
KEPT = 200_000

_NONE = np.iinfo(np.int64).max
_PLACE = 32
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")  # two pre-tokens that only case folding changes


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as it is, the others from 256 on."""
    shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b and b != 173]
    hidden = sorted({*range(256)} - {*shown})
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Bpe:
    """Tables of a tokenizers file: ids of bytes (inside a pre-token and at its end), merges by pair, texts of ids."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = _byte_letters()
        self.inside = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], np.int64)
        self.bytes_of = {ord(c): chr(b) for b, c in letters.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys))))
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        tokenizer = Tokenizer.from_file(path)
        self.normalize, self.pre_tokenize = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.any_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        written = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.written = [written.get(i, "") for i in range(max(written) + 1)]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; -1 where they can't be merged."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merge_one(self, word: bytes) -> list[int]:
        """Ids of one pre-token of any length."""
        n = len(word)
        ids = [*self.inside[np.frombuffer(word[:-1], np.uint8)].tolist(), int(self.last[word[-1]])]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        size = 1 << max(1, n - 1).bit_length()
        none = 1 << 62
        find, merged = self.rank_of.get, self.merged.tolist()

        def value(i: int) -> int:
            j = after[i]
            r = find(ids[i] << 32 | ids[j]) if j < n else None
            return none if r is None else r << _PLACE | i

        tree = [none] * (2 * size)
        tree[size : size + n] = map(value, range(n))
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b

        def put(i: int, v: int) -> None:
            k = size + i
            tree[k] = v
            while k > 1:
                other = tree[k ^ 1]
                k >>= 1
                if other < v:
                    v = other
                if tree[k] == v:
                    return
                tree[k] = v

        while (top := tree[1]) < none:
            i = top & ((1 << _PLACE) - 1)
            j = after[i]
            ids[i], ids[j] = merged[top >> _PLACE], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            put(j, none)
            put(i, value(i))
            if before[i] >= 0:
                put(before[i], value(before[i]))
        return [i for i in ids if i >= 0]

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each of some pre-tokens of at most BULK bytes: all trees at once, a merge in each a round."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        n = int(lengths.max())
        size = 1 << n.bit_length()
        rows = len(words)
        col = np.arange(n + 2)
        there = (col >= 1) & (col <= lengths[:, None])  # symbols stand in columns 1 to n, a pair's leaf in that of its left symbol
        raw = np.frombuffer(b"".join(words), np.uint8)
        ids = np.full((rows, n + 2), -1, np.int64)
        ids[there] = self.inside[raw]
        ids[np.arange(rows), lengths] = self.last[raw[np.cumsum(lengths) - 1]]
        after = np.broadcast_to(col + 1, ids.shape).copy()
        before = np.broadcast_to(col - 1, ids.shape).copy()
        tree = np.full((rows, 2 * size), _NONE, np.int64)
        pair = there[:, 1:-1] & there[:, 2:]
        at = np.flatnonzero(pair)
        r = self.rank(ids[:, 1:-1].ravel()[at], ids[:, 2:].ravel()[at])
        value = np.full(pair.shape, _NONE, np.int64)
        value.ravel()[at] = np.where(r >= 0, r << _PLACE | (at % n + 1), _NONE)
        tree[:, size + 1 : size + 1 + n] = value
        for k in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        flat, leaf = tree.ravel(), ids.ravel()
        nexts, lasts = after.ravel(), before.ravel()
        active = np.arange(rows)

        def put(row: np.ndarray, column: np.ndarray, v: np.ndarray | int) -> None:
            k, base = column + size, row * (2 * size)
            flat[base + k] = v
            for _ in range(size.bit_length() - 1):
                k = k >> 1
                flat[base + k] = np.minimum(flat[base + 2 * k], flat[base + 2 * k + 1])

        def fresh(row: np.ndarray, i: np.ndarray) -> np.ndarray:
            base = row * (n + 2)
            r = self.rank(leaf[base + i], leaf[base + nexts[base + i]])
            return np.where(r >= 0, r << _PLACE | i, _NONE)

        while len(active):
            top = flat[active * (2 * size) + 1]
            active, top = active[top < _NONE], top[top < _NONE]
            i, base = top & ((1 << _PLACE) - 1), active * (n + 2)
            j = nexts[base + i]
            leaf[base + i], leaf[base + j] = self.merged[top >> _PLACE], -1
            nexts[base + i] = nexts[base + j]
            lasts[base + nexts[base + j]] = i
            put(active, j, _NONE)
            put(active, i, fresh(active, i))
            k = lasts[base + i]
            held = k >= 1
            put(active[held], k[held], fresh(active[held], k[held]))
        left = ids >= 0
        ends = np.cumsum(left.sum(axis=1)) * 4
        out = ids[left].astype("<u4").tobytes()
        return [out[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def decode(self, ids: np.ndarray) -> str:
        """The text that the vocabulary's writing of the ids, without a decoder, gives: the tokens with blanks between them."""
        return " ".join(map(self.written.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=2)
def tables(path: str) -> Bpe:
    return Bpe(path)


class Encoder:
    """Encodes texts; ids of stretches and of pre-tokens that come again are kept, up to a bound."""

    def __init__(self, path: str) -> None:
        self.bpe = tables(path)
        self.stretches: dict[str, bytes] = {}
        self.parts: dict[bytes, bytes] = {}

    def split(self, stretch: str) -> list[bytes | int]:
        """Pre-tokens of a stretch without blanks; a special token's id instead of one."""
        if m := _PLAIN.fullmatch(stretch):
            return [p.encode() for p in (m[1].lower(), m[2]) if p]
        bpe, out = self.bpe, []
        for piece in bpe.any_special.split(stretch) if bpe.any_special else [stretch]:
            if piece in bpe.special:
                out.append(bpe.special[piece])
            elif piece:
                out += [p.translate(bpe.bytes_of).encode("latin-1") for p, _ in bpe.pre_tokenize(bpe.normalize(piece))]
        return out

    def learn(self, stretches: set[str]) -> None:
        """Work out the ids of some stretches."""
        split = {s: self.split(s) for s in stretches}
        if len(self.parts) > KEPT:
            self.parts.clear()
        new = {p for parts in split.values() for p in parts if isinstance(p, bytes) and p not in self.parts}
        short = sorted((p for p in new if len(p) <= BULK), key=len)
        for a in range(0, len(short), AT_ONCE):
            b = a
            while b < min(len(short), a + AT_ONCE):  # trees of one size
                c = b
                size = len(short[b]).bit_length()
                while c < min(len(short), a + AT_ONCE) and len(short[c]).bit_length() == size:
                    c += 1
                self.parts.update(zip(short[b:c], self.bpe.merge_many(short[b:c])))
                b = c
        for p in new:
            if len(p) > BULK:
                self.parts[p] = np.array(self.bpe.merge_one(p), "<u4").tobytes()
        for s, parts in split.items():
            self.stretches[s] = b"".join(self.parts[p] if isinstance(p, bytes) else np.array([p], "<u4").tobytes() for p in parts)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text. No pre-token crosses a blank or a line's end, so each stretch between them is encoded once."""
        split = [(t or "").replace("\n", " ").split(" ") for t in texts]
        wanted = {s for x in split for s in x}
        if len(self.stretches) > KEPT:
            self.stretches.clear()
        self.learn(wanted - self.stretches.keys())
        return [b"".join(map(self.stretches.__getitem__, x)) for x in split]


def _mapped(docs: DataFrame, path: str, fn, schema: str) -> DataFrame:
    """doc_id with the columns that fn(encoder, batch) gives, by name."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in parts_of(batches):
            columns = {"doc_id": batch.column("doc_id")} | fn(encoder, batch)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(run, f"doc_id {kind}, {schema}")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit) of every row of docs, as the tokenizers library encodes its text without adding special tokens.

    A null or empty text has no ids. Strings of special tokens in a text are those tokens, as the library takes them. Repeated rows
    repeat; of pairs of equal rank the leftmost is merged first. Other columns are left out; an empty table gives no rows."""

    def ids(encoder: Encoder, batch: pa.RecordBatch) -> dict[str, pa.Array]:
        found = encoder.encode(batch.column("text").to_pylist())
        return {"n_tokens": pa.array([len(x) // 4 for x in found], pa.int64()), "ids": pa.array(found, pa.binary())}

    return _mapped(docs.select("doc_id", "text"), path or vocabulary(), ids, "n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of every row (doc_id, ids) of encode(); null ids give an empty text."""

    def texts(encoder: Encoder, batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"text": pa.array([encoder.bpe.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column("ids").to_pylist()], pa.string())}

    return _mapped(encoded.select("doc_id", "ids"), path or vocabulary(), texts, "text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and of the decoded text, of every row of docs; one pass makes both, so ids don't leave the task."""

    def both(encoder: Encoder, batch: pa.RecordBatch) -> dict[str, pa.Array]:
        found = encoder.encode(batch.column("text").to_pylist())
        back = (encoder.bpe.decode(np.frombuffer(x, "<u4")).encode() for x in found)
        return {
            "n_tokens": pa.array([len(x) // 4 for x in found], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
        }

    return _mapped(docs.select("doc_id", "text"), path or vocabulary(), both, "n_tokens long, ids_sha256 string, decoded_sha256 string")
