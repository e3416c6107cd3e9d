"""Helpers that several corpus operators share: words, shingles, batches and components."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codonweave.session import discard, materialize, ship

if TYPE_CHECKING:  # most workers need no pandas, which takes 27 MB of each
    import pandas as pd

#: Rows and bytes that are worked on at once; Spark bounds the bytes of an Arrow batch, this what Python makes of it.
BATCH_ROWS, BATCH_BYTES = 512, 2 << 20
#: Bytes whose words are hashed at once; a longer word is taken alone.
PIECE = 1 << 15
SHINGLE = 5

_MASK = (1 << 64) - 1
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.lru_cache(maxsize=1)
def _lean() -> None:
    """Let this worker give memory back once it is freed: larger blocks are mapped by themselves, and Arrow keeps none in a pool.

    A worker goes from stage to stage, and what it has held at most would stay with it."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD of glibc
    except (AttributeError, OSError):
        pass  # another C library


#: Bytes that a worker keeps for its next arrays, see roomy().
ROOM = 32 << 20


@functools.lru_cache(maxsize=1)
def roomy() -> None:
    """Let this worker keep up to ROOM bytes that it has freed, for tasks that make arrays again and again.

    Else glibc hands whatever is freed at the heap's end back at once, and the next array is mapped anew page by page, which
    takes longer than the work on it."""
    _lean()
    try:
        ctypes.CDLL(None).mallopt(-1, ROOM)  # M_TRIM_THRESHOLD of glibc
    except (AttributeError, OSError):
        pass  # another C library


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of at most BATCH_ROWS rows, of fewer where rows are long; an empty batch stays as it is."""
    _lean()
    for whole in batches:
        rows = min(BATCH_ROWS, max(1, whole.num_rows * BATCH_BYTES // max(1, whole.nbytes)))
        for a in range(0, max(1, whole.num_rows), rows):
            yield whole.slice(a, rows)


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Pandas frames of parts_of(); whole numbers among nulls stay whole numbers."""
    import pandas as pd

    def column(c: pa.Array) -> pd.Series:
        if c.null_count and pa.types.is_integer(c.type):
            return c.to_pandas(types_mapper=lambda t: pd.Int64Dtype())
        return c.to_pandas()

    for batch in parts_of(batches):
        yield pd.DataFrame({name: column(c) for name, c in zip(batch.schema.names, batch.columns)})


def map_rows(df: DataFrame, fn, schema: str | T.StructType) -> DataFrame:
    """Rows of the frames that fn(iterator of pandas frames of at most BATCH_ROWS rows) gives."""
    ship(df.sparkSession)
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(_frames(batches)):
            yield pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)

    return df.mapInArrow(run, schema)


def encode(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null counts as empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lowered() -> np.ndarray:
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    return low


#: The byte that stands for each byte of a word: A-Z as a-z; which bytes part words; what a byte is worth in a word's hash.
LOWERED = _lowered()
_WHITE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_VALUE = mix(LOWERED.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the hash's base and of its inverse, modulo 2^64, up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(PIECE, n) + 1
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers.append(np.cumprod(x, dtype=np.uint64))
    return _powers


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of some texts, where their words start and end, and the number of words of each text; a null text has none."""
    texts = texts.fill_null("")
    _, place, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(place, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    n = len(raw)
    inside = np.zeros(n + 2, bool)
    np.logical_not(_WHITE[raw], out=inside[1:-1])
    begins, stops = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins[edges] |= inside[edges + 1]
    stops[edges - 1] |= inside[edges]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return raw, starts, ends, np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased: a polynomial of its bytes, from running sums."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
        first, last = starts[i], ends[j - 1]
        power, inverse = _power_tables(last - first)
        total = np.zeros(last - first + 1, np.uint64)
        np.cumsum(_VALUE[raw[first:last]] * power[: last - first], out=total[1:])
        a, b = starts[i:j] - first, ends[i:j] - first
        out[i:j] = (total[b] - total[a]) * inverse[a]
        i = j
    return out


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct hashes, as signed longs, of the k-word windows of each text, A-Z lower-cased.

    A text of fewer words is one window; without words, or null, it has none."""
    raw, starts, ends, lengths = split_words(texts)
    h = mix(hash_words(raw, starts, ends))
    many = max(0, len(h) - k + 1)
    s = np.zeros(many, np.uint64)
    for i in range(k):
        s += h[i : many + i] * _ODD[i]
    s = mix(s).view(np.int64)
    out = []
    for end, n in zip(np.cumsum(lengths).tolist(), lengths.tolist()):
        if n >= k:
            x = np.sort(s[end - n : end - k + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        else:
            out.append(mix((h[end - n : end] * _ODD[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)).view(np.int64) if n else np.empty(0, np.int64))
    return out


def shingles(words: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """Hashes of the k-word windows in order; a shorter sequence is one shingle; none without words."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    if n < k:
        return mix((h * _ODD[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    s = h[: n - k + 1] * _ODD[0]
    for i in range(1, k):
        s = s + h[i : n - k + 1 + i] * _ODD[i]
    return mix(s)


def lower_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased."""
    return encode(text).lower().split()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of an undirected graph given as pairs of longs; component is the least node.

    Alternating large-star and small-star rounds, each written to the shared folder, until
    nothing changes. Nulls and self-links are ignored; an empty table gives an empty result."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    e = materialize(e)

    def digest(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    seen = digest(e)
    while seen[0]:
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array("u", "v")).alias("x"), "m").filter("x > m")
        before, e = e, materialize(small.select(F.col("x").alias("u"), F.col("m").alias("v")).distinct())
        discard(before)
        now = digest(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def filter_rows(docs: DataFrame, keep, text: str = "text") -> DataFrame:
    """The rows for which keep(list of texts) says so, with all columns of docs as they are."""

    def run(batches):
        for batch in parts_of(batches):
            yield batch.filter(pa.array(np.asarray(keep(batch.column(text).to_pylist()), dtype=bool)))

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def map_text(docs: DataFrame, change, text: str = "text") -> DataFrame:
    """docs with change(list of texts) in place of its texts; all other columns as they are."""

    def run(batches):
        for batch in parts_of(batches):
            k = batch.schema.get_field_index(text)
            new = pa.array(change(batch.column(k).to_pylist()), type=batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays([new if i == k else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
