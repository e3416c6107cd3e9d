"""Sum-of-squares packing of token sequences into windows of fixed size.

Each document goes, as it comes, to the fill level that makes the sum of squared counts of partially filled
windows least; a level array holds the counts. Documents longer than a window are cut
into full windows and a rest. What is still open when a partition ends is closed by cutting: the
fullest windows are filled up from the emptiest, and the last tokens are cut into windows whose
lengths are powers of two, which need no padding."""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from codonweave.llm.common import parts_of
from codonweave.session import ship

WINDOW = 4096
END = 2
#: Words whose ids a task keeps as the newer and as the older ones; none outlive the task, as the worker may next do something else.
KEPT_WORDS = 200_000


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Bytes as the vocabulary writes them: printable ones as they are, the others from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*_PRINTED}))}
#: A run of Latin letters, then ASCII punctuation without apostrophes: two pre-tokens that case folding alone changes.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


#: Packers of so many ids, made once.
_PACKERS = [struct.Struct(f"<{n}I").pack for n in range(64)]


def _packed(ids: list[int]) -> bytes:
    n = len(ids)
    return _PACKERS[n](*ids) if n < 64 else struct.pack(f"<{n}I", *ids)


class _Ids(dict):
    """Little-endian 32-bit ids of stretches without blanks, worked out once. What was asked for lately stays: a full dict becomes
    the older one, in place of the one before, and what is asked for again comes back from it."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.tokenizer = _tokenizer(path)
        self.tokenize = self.tokenizer.model.tokenize

    def __missing__(self, stretch: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.older = dict(self)
            self.clear()
        if (ids := self.older.get(stretch)) is None:
            ids = self.new(stretch)
        self[stretch] = ids
        return ids

    def new(self, stretch: str) -> bytes:
        if stretch.isascii() and stretch.isalpha():
            run, marks = stretch, ""
        elif m := _PLAIN.fullmatch(stretch):
            run, marks = m.groups()
        else:
            return _packed(self.tokenizer.encode(stretch, add_special_tokens=False).ids)
        low = run.lower()
        if marks:
            return self[low] + self[marks]
        if low != run:
            return self[low]
        # one pre-token; printable ASCII is written as it is
        return _packed([t.id for t in self.tokenize(run if run.isascii() else run.encode().decode("latin-1").translate(_BYTES))])


def token_bytes(texts: list[str | None], path: str, known: _Ids | None = None) -> list[bytes]:
    """Little-endian 32-bit ids of each text. No token crosses white space, so each stretch without blanks is encoded once, and not
    again where it is in known."""
    ids = (_Ids(path) if known is None else known).__getitem__
    return [b"".join(map(ids, (t or "").replace("\n", " ").split(" "))) for t in texts]


def split(piece: tuple, size: int) -> tuple[tuple, tuple]:
    """The first size tokens of a piece, and the others."""
    doc, start, length, tokens, ids = piece
    return (doc, start, size, tokens, ids[: 4 * size]), (doc, start + size, length - size, tokens, ids[4 * size :])


class Packer:
    """Windows of one partition. A piece is (document, start, length, tokens of the document, the piece's own ids as bytes).

    cut: tokens that close() has placed, not the level array."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.counts = np.zeros(window, np.int64)
        self.open: dict[int, list[list]] = {}
        self.cut = 0

    def level(self, size: int) -> int:
        """The fill level to which a document of less than a window goes; 0 opens a window."""
        n, top = self.counts, self.window - size
        if top < 1:
            return 0
        here = n[1 : top + 1]
        then = np.append(n[size + 1 :], -0.5)  # a full window is no longer counted
        change = np.where(here > 0, then - here + 1, np.inf)
        k = len(change) - 1 - int(np.argmin(change[::-1]))
        return k + 1 if change[k] <= n[size] + 0.5 else 0

    def add(self, piece: tuple) -> list | None:
        """Place a piece; the window that it fills, if it does."""
        size = piece[2]
        if size == self.window:
            return [piece]
        h = self.level(size)
        if h:
            self.counts[h] -= 1
            held = self.open[h].pop()
        else:
            held = []
        held.append(piece)
        if h + size == self.window:
            return held
        self.counts[h + size] += 1
        self.open.setdefault(h + size, []).append(held)
        return None

    def close(self) -> Iterator[list]:
        """All windows still open, filled up by cutting."""
        left = [[sum(p[2] for p in w), w] for h in sorted(self.open) for w in self.open[h]]
        self.counts[:] = 0
        self.open = {}
        low, high = 0, len(left) - 1
        while low < high:
            lack = self.window - left[high][0]
            if lack == 0:
                yield left[high][1]
                high -= 1
                continue
            piece = left[low][1].pop()
            if piece[2] > lack:
                first, piece = split(piece, piece[2] - lack)
                left[low][1].append(first)
            left[low][0] -= piece[2]
            left[high][0] += piece[2]
            left[high][1].append(piece)
            self.cut += piece[2]
            if not left[low][0]:
                low += 1
        if low == high:
            rest = left[low][1]
            lengths = [1 << b for b in range(self.window.bit_length(), -1, -1) if left[low][0] >> b & 1]
            for length in lengths:
                held = []
                self.cut += length
                while length:
                    piece = rest.pop(0)
                    if piece[2] > length:
                        piece, second = split(piece, length)
                        rest.insert(0, second)
                    held.append(piece)
                    length -= piece[2]
                yield held


def _packed_rows(docs: DataFrame, path: str | None, window: int, end: int, last: tuple[str, str], of_ids) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset of every piece, and the column `last` (name, type): of_ids(list of the pieces' ids)."""
    path = path or vocabulary()
    kind = docs.schema["doc_id"].dataType.simpleString()
    ending = np.array([end], dtype="<u4").tobytes()
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", last[0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 32
        packer, known = Packer(window), _Ids(path)

        def rows(held: list) -> list[tuple]:
            nonlocal sequence
            out, offset = [], 0
            for doc, start, size, tokens, ids in held:
                out.append((doc, start, size, tokens, sequence, offset, ids))
                offset += size
            sequence += 1
            return out

        def batch_of(done: list[tuple], doc_kind: pa.DataType) -> pa.RecordBatch:
            doc, *numbers, ids = zip(*done)
            return pa.RecordBatch.from_arrays([pa.array(doc, doc_kind), *[pa.array(x, pa.int64()) for x in numbers], of_ids(ids)], names=names)

        done: list[tuple] = []
        for batch in parts_of(batches):
            doc_kind = batch.schema.field("doc_id").type
            for doc, ids in zip(batch.column("doc_id").to_pylist(), token_bytes(batch.column("text").to_pylist(), path, known)):
                ids += ending
                tokens = len(ids) // 4
                for start in range(0, tokens, window):
                    own = ids[4 * start : 4 * (start + window)]
                    if held := packer.add((doc, start, len(own) // 4, tokens, own)):
                        done += rows(held)
            if done:
                yield batch_of(done, doc_kind)
                done = []
        for held in packer.close():
            done += rows(held)
            if len(done) > 2000:
                yield batch_of(done, doc_kind)
                done = []
        if done:
            yield batch_of(done, doc_kind)

    ship(docs.sparkSession)
    schema = f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, {last[0]} {last[1]}"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end: int = END) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian 32-bit) of every piece.

    window: a power of two. A null or empty text is its end id alone. Each row of docs is packed,
    repeated ones too; partitions are packed on their own, documents as they come, of equal choices the highest level.
    Other columns of docs are left out; an empty table gives no rows. A piece keeps its own ids only."""
    return _packed_rows(docs, path, window, end, ("ids", "binary"), lambda ids: pa.array(ids, pa.binary()))


def pieces(docs: DataFrame, path: str | None = None, window: int = WINDOW, end: int = END) -> DataFrame:
    """pack() with the CRC-32 of each piece's ids, worked out beside them, in place of the ids; the same rows for null, empty and repeated texts."""
    out = _packed_rows(docs, path, window, end, ("ids_crc32", "long"), lambda ids: pa.array([zlib.crc32(x) for x in ids], pa.int64()))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
