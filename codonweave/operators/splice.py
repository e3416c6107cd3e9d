"""Splice-site scores from maximum-entropy coefficients.

A donor is scored from three bases before and four after GT, an acceptor from 18 before and three after AG.
Coefficients are a table (arr, idx, coef) of bounded size: 4 ** 7 donor rows, 82,560 acceptor rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codonweave.functions import scalars
from codonweave.session import ship

# Scale factors, and the inclusive windows of the acceptor's 21 bases that multiply and divide.
DONOR_FACTOR, ACCEPTOR_FACTOR = 16.302010666666664, 16.3482025
TIMES = ((0, 6), (7, 13), (14, 20), (4, 10), (11, 17))
DIVIDE = ((4, 6), (7, 10), (11, 13), (14, 17))

#: Bases that a chunk repeats from the one before: the longest site with its context has one more. Other bases of a chunk.
OVERLAP, CHUNK = 22, 1 << 16
#: Sites that are handed on at once.
SITES = 50_000

SIZES = [4 ** (b - a + 1) for a, b in (*TIMES, *DIVIDE)]


def donor_score(df: DataFrame, context: str, coefficients: DataFrame, name: str = "donor_score") -> DataFrame:
    """df with the score of its 7-base context; null for other letters or a zero coefficient. Other than 4 ** 7 coefficients are an error."""
    if (n := coefficients.count()) != 4**7:  # so it may be broadcast
        raise ValueError(f"{n} donor coefficients")
    coef = coefficients.select(F.col("idx").alias("_i"), F.col("coef").alias("_c"))
    return df.withColumn("_i", scalars.kmer_index(context)).join(F.broadcast(coef), "_i", "left").withColumn(name, F.log2(F.lit(DONOR_FACTOR) * F.col("_c"))).drop("_i", "_c")


def read_tables(coefficients: DataFrame) -> list[np.ndarray]:
    """The nine acceptor tables, by arr and idx. Other than their fixed number of coefficients are an error, before any is fetched."""
    if (n := coefficients.count()) != sum(SIZES):
        raise ValueError(f"{n} acceptor coefficients")
    rows = coefficients.select("arr", "idx", "coef").toPandas().sort_values(["arr", "idx"])
    out = [g["coef"].to_numpy() for _, g in rows.groupby("arr")]
    if [len(x) for x in out] != SIZES:
        raise ValueError("acceptor tables have wrong sizes")
    return out


def acceptor_score(df: DataFrame, context: str, coefficients: DataFrame, name: str = "acceptor_score") -> DataFrame:
    """df with the score of its 21-base context (18 before AG, three after); null for other letters."""
    ship(df.sparkSession)
    tables = df.sparkSession.sparkContext.broadcast(read_tables(coefficients))
    index: list[Column] = [scalars.kmer_index(F.substring(F.col(context), a + 1, b - a + 1)) for a, b in (*TIMES, *DIVIDE)]

    @F.pandas_udf(T.DoubleType())
    def score(*idx: pd.Series) -> pd.Series:
        got = [t[i.to_numpy(np.int64)] for t, i in zip(tables.value, idx)]
        return pd.Series(np.log2(ACCEPTOR_FACTOR * reduce(np.multiply, got[:5]) / reduce(np.multiply, got[5:])))

    good = F.col(context).rlike("^[ACGT]{21}$")
    return df.withColumn(name, F.when(good, score(*[F.coalesce(i, F.lit(0)) for i in index])))


def overlapping(pieces: DataFrame, size: int = CHUNK) -> DataFrame:
    """Pieces (name, offset, seq) of sequences, of any lengths and without gaps, as the chunks that splice_sites() takes.

    A chunk has `size` bases and the OVERLAP before them, so no row and no group is longer, whatever a sequence's length.
    Chunks of null or empty pieces are left out."""
    known = pieces.filter("length(seq) > 0").select("name", F.col("offset").cast("long").alias("offset"), "seq")
    end = F.col("offset") + F.length("seq")
    chunk = F.explode(F.sequence(F.floor(F.col("offset") / size), F.floor((end - 1 + OVERLAP) / size)))
    cut = known.withColumn("chunk", chunk).withColumns({"a": F.greatest("offset", F.col("chunk") * size - OVERLAP), "b": F.least(end, (F.col("chunk") + 1) * size)}).filter("a < b")
    part = F.substring(F.col("seq"), (F.col("a") - F.col("offset") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int"))
    own = cut.groupBy("name", "chunk").agg(F.array_sort(F.collect_list(F.struct("a", part.alias("s")))).alias("parts"), F.max("b").alias("b"))
    own = own.filter((F.col("chunk") == 0) | (F.col("b") > F.col("chunk") * size))  # one with nothing but its overlap is the end of the last
    return own.select("name", F.element_at("parts", 1)["a"].alias("offset"), F.array_join(F.transform("parts", lambda p: p["s"]), "").alias("seq"))


_FOLD = np.frombuffer(bytes(range(256)).translate(bytes.maketrans(b"ACGT", b"TGCA")), np.uint8)


def _contexts(base: np.ndarray, at: np.ndarray, before: int, after: int, forward: bool) -> np.ndarray:
    """The bases around the motifs at `at`, a row for each: before and after the motif in the direction of its strand."""
    if forward:
        return base[at[:, None] + np.append(np.arange(-before, 0), np.arange(2, 2 + after))]
    return _FOLD[base[at[:, None] + np.append(np.arange(1 + before, 1, -1), np.arange(-1, -1 - after, -1))]]


def splice_sites(chunks: DataFrame) -> DataFrame:
    """Sites with whole context in both strands of chunks (name, offset, seq; upper case).

    Rows: name, strand, kind, pos (1-based place of the site's first base on its strand), context. A chunk that does not begin
    a sequence (offset above 0) must start with the OVERLAP last bases of the one before, as those of overlapping() do; sites
    that lie in these bases with their whole context are that one's. Each chunk is gone through once; null ones have none."""
    ship(chunks.sparkSession)
    motifs = [(kind, motif, before, after, forward) for kind, motif, before, after in (("donor", b"GT", 3, 4), ("acceptor", b"AG", 18, 3)) for forward in (True, False)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[pa.RecordBatch] = []
        for batch in batches:
            if sum(b.num_rows for b in done) > SITES:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                done = []
            offsets = batch.column("offset").to_numpy(zero_copy_only=False)
            for row, seq in enumerate(batch.column("seq")):
                raw = seq.as_buffer()
                base = np.frombuffer(raw, np.uint8) if raw else np.empty(0, np.uint8)
                if len(base) < 2:
                    continue
                name = batch.column("name").slice(row, 1)
                own = OVERLAP if offsets[row] else 0
                for kind, motif, before, after, forward in motifs:
                    x, y = motif if forward else (_FOLD[motif[1]], _FOLD[motif[0]])
                    at = np.flatnonzero((base[:-1] == x) & (base[1:] == y))
                    left, right = (before, after) if forward else (after, before)
                    at = at[(at >= left) & (at + 2 + right <= len(base)) & (at + 2 + right > own)]
                    if not len(at):
                        continue
                    context = np.ascontiguousarray(_contexts(base, at, before, after, forward))
                    text = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(np.arange(0, context.size + 1, context.shape[1], dtype=np.int32)), pa.py_buffer(context)])
                    many = pa.array(np.zeros(len(at), np.int64))
                    strand = pa.array(["+" if forward else "-"]).take(many)
                    done.append(pa.RecordBatch.from_arrays([name.take(many), strand, pa.array([kind]).take(many), pa.array(offsets[row] + at + (1 if forward else 2)), text], names=["name", "strand", "kind", "pos", "context"]))
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()

    own = chunks.select("name", F.col("offset").cast("long").alias("offset"), F.col("seq").cast("binary").alias("seq"))
    return own.mapInArrow(scan, f"name {chunks.schema['name'].dataType.simpleString()}, strand string, kind string, pos long, context string")


def scan_splice_sites(chunks: DataFrame, donors: DataFrame, acceptors: DataFrame) -> DataFrame:
    """splice_sites() with score; sites whose context has other letters are left out."""
    found = splice_sites(chunks).filter(F.col("context").rlike("^[ACGT]+$"))
    a = donor_score(found.filter("kind = 'donor'"), "context", donors, "score")
    b = acceptor_score(found.filter("kind = 'acceptor'"), "context", acceptors, "score")
    return a.unionByName(b)
