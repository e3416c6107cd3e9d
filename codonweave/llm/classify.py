"""What the two text classifiers share: character n-grams, held-out rows and bounded samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_FOLD = np.arange(0x250, dtype=np.uint32)
for _c in range(0x250):
    if not chr(_c).isalpha():
        _FOLD[_c] = 32


def letters(text: str | None) -> np.ndarray:
    """Lower-case code points of a text between blanks; below U+0250 all but letters become blanks."""
    raw = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
    low = raw < 0x250
    raw[low] = _FOLD[raw[low]]
    return raw


def ngrams(codes: np.ndarray, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """The bucket of every n-gram of the given sizes."""
    out = []
    h = np.zeros(len(codes), np.uint64)
    wide = codes.astype(np.uint64)
    for n in range(1, max(sizes) + 1):
        if n > len(codes):
            break
        m = len(codes) - n + 1
        h = (h[:m] + wide[n - 1 : n - 1 + m] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h = h ^ (h >> np.uint64(29))
        if n in sizes:
            out.append(((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no classifier may learn from; rows without an id are among them."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def bounded_sample(rows: DataFrame, label: str, keys: list[str], most: int) -> DataFrame:
    """At most `most` rows of each label, those of least hash of the keys; all where there are no more.

    Rows whose hash is far above what `most` of them need are dropped before the labels are sorted, so a label's window
    holds little more than it returns. Rows that repeat a label and keys come in once."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    whole = 1 << 40
    spot = F.pmod(F.xxhash64(*keys), F.lit(whole))
    bound = F.lit(-1).cast("long")
    for value, n in counts.items():
        bound = F.when(F.col(label) == F.lit(value), F.lit(min(whole, int((most + 10 * most**0.5 + 20) / n * whole)))).otherwise(bound)
    near = rows.withColumn("_spot", spot).filter(F.col("_spot") < bound).dropDuplicates([label, "_spot"])
    place = F.row_number().over(W.partitionBy(label).orderBy("_spot"))
    return near.withColumn("_place", place).filter(F.col("_place") <= most).drop("_spot", "_place")
