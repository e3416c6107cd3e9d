"""Comparison of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codonweave.session import materialize


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: rows, and the sum and xor of row hashes; equal for equal tables in any order."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return df.agg(F.count("*").alias("rows"), F.sum(h.cast("decimal(20,0)")).alias("total"), F.bit_xor(h).alias("mixed"))


def tables_equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same rows as often: by their number and two sums of row hashes, so in one aggregate each."""
    if sorted(a.columns) != sorted(b.columns):
        return False
    marks = [x.agg(F.count("*"), *_sums(sorted(a.columns))).first() for x in (a, b)]
    return marks[0] == marks[1]


def _sums(columns: list[str]) -> list[Column]:
    """Two sums of independent hashes of rows."""
    own = [F.col(f"`{c}`") for c in columns]
    return [F.sum(h.cast("decimal(20,0)")).alias(n) for n, h in (("_s1", F.xxhash64(*own)), ("_s2", F.xxhash64(F.lit("other"), *own)))]


#: Buckets of keys whose sums are compared, level by level.
LEVELS = (1 << 12, 1 << 20)


def _suspects(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of a and b whose keys lie in buckets that differ: first of 4,096, then within those of a million.

    The table of buckets has one row a bucket at most and is broadcast."""
    spot = F.xxhash64(*[F.col(f"`{k}`") for k in keys])
    for many in LEVELS:
        bucket = F.pmod(spot, F.lit(many)).alias("_bucket")
        marks = [x.groupBy(bucket).agg(F.count("*").alias("_n"), *_sums(columns)) for x in (a, b)]
        other = marks[1].withColumnsRenamed({c: f"{c}2" for c in ("_n", "_s1", "_s2")})
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}2")) for c in ("_n", "_s1", "_s2")])
        differ = materialize(marks[0].join(other, "_bucket", "full_outer").filter(~same).select("_bucket"))
        n = differ.count()
        if not n:
            return a.limit(0), b.limit(0)
        if 2 * n > many:
            return a, b
        a, b = (x.withColumn("_bucket", F.pmod(spot, F.lit(many))).join(F.broadcast(differ), "_bucket", "left_semi").drop("_bucket") for x in (a, b))
    return a, b


def diff_tables(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Keys of rows that differ, with side (left, right or both) and the columns that do.

    Floating-point columns may differ by tolerance. Only rows of buckets whose sums of hashes differ meet, so tables that are
    alike cost two aggregates. Rows that repeat a key are compared as multisets: equal rows cancel out, and those left over stand
    against each other in the order of their columns. A null key is a key."""
    rest = [c for c in a.columns if c not in keys]
    kinds = dict(a.dtypes)
    x, y = _suspects(a, b.select(*[F.col(f"`{c}`") for c in a.columns]), keys, a.columns)
    signed = x.withColumn("_side", F.lit(1)).unionByName(y.withColumn("_side", F.lit(-1)))
    left_over = signed.groupBy(*a.columns).agg(F.sum("_side").alias("_net")).filter("_net <> 0")
    rows = left_over.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_net"))))
    place = F.row_number().over(W.partitionBy(*keys, F.signum("_net")).orderBy(*rest, "_copy"))
    rows = rows.withColumn("_place", place)
    own = ["_place", *keys]
    left = rows.filter("_net > 0").select(*own, *[F.col(f"`{c}`").alias(f"_l_{c}") for c in rest], F.lit(True).alias("_l"))
    right = rows.filter("_net < 0").select(*[F.col(f"`{k}`").alias(f"_k_{k}") for k in own], *[F.col(f"`{c}`").alias(f"_r_{c}") for c in rest], F.lit(True).alias("_r"))
    both = left.join(right, reduce(Column.__and__, [F.col(f"`{k}`").eqNullSafe(F.col(f"_k_{k}")) for k in own]), "full_outer")

    def off(c: str):
        x, y = F.col(f"_l_{c}"), F.col(f"_r_{c}")
        if kinds[c] in ("double", "float"):
            return F.when(x.isNull() | y.isNull(), ~x.eqNullSafe(y)).otherwise(F.abs(x - y) > tolerance)
        return ~x.eqNullSafe(y)

    side = F.when(F.col("_r").isNull(), "left").when(F.col("_l").isNull(), "right").otherwise("both")
    columns = F.array_compact(F.array(*[F.when(off(c), F.lit(c)) for c in rest])) if rest else F.array().cast("array<string>")
    named = [F.when(F.col("_l").isNull(), F.col(f"_k_{k}")).otherwise(F.col(f"`{k}`")).alias(k) for k in keys]
    out = both.select(*named, side.alias("side"), columns.alias("columns"))
    return out.filter((F.col("side") != "both") | (F.size("columns") > 0))


def diff_lines(a: DataFrame, b: DataFrame) -> DataFrame:
    """line_no, side, left and right where two files' lines (line_no from 1, value) differ; line by line, also beyond the end of the shorter one."""
    x, y = a.select("line_no", F.col("value").alias("left")), b.select("line_no", F.col("value").alias("right"))
    found = diff_tables(a.select("line_no", "value"), b.select("line_no", "value"), ["line_no"]).select("line_no", "side")
    return found.join(x, "line_no", "left").join(y, "line_no", "left")
