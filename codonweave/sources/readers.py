"""Readers of the text and binary formats of coding-region work. Gzip is read by file extension."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from codonweave.functions import scalars
from codonweave.session import ship


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value, file and line_no (increasing in the file, not gapless), for files split over many tasks."""
    df = spark.read.text(path)
    return df.select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("line_no"))


def read_in_order(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value and line_no, from 1 without gaps: the lines of files in the order of their names, each in its own order.

    A line's number is its place in its split, and the lines of all splits before; there is one row a split of these."""
    lines = numbered_lines(spark, path).select("value", "file", F.col("line_no.block").alias("block"), F.col("line_no.row").alias("row"))
    splits = lines.groupBy("file", "block").agg(F.min("row").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("file", "block")) - F.col("_n")
    splits = splits.select("file", "block", (before - F.col("_first") + 1).alias("_more"))
    return lines.join(splits, ["file", "block"]).select("value", (F.col("row") + F.col("_more")).alias("line_no"))


def parse_codon_scores(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines 'CHROM:START-END STRAND STATUS SCORE BLS' to chrom, strand, frame, pos, status, score, bls.

    Also for streams. Lines without alignment (or with a failure) have no score; blank lines are left out."""
    w = F.split(F.trim(F.col(value)), r"\s+")
    region = r"^(.+):(\d+)-(\d+)$"
    pos = F.regexp_extract(w[0], region, 2).try_cast("long")
    scored = F.size(w) >= 5
    return lines.filter(F.trim(F.col(value)) != "").select(
        *[c for c in lines.columns if c != value],
        F.regexp_extract(w[0], region, 1).alias("chrom"), w[1].alias("strand"), scalars.frame(pos).alias("frame"), pos.alias("pos"), w[2].alias("status"),
        F.when(scored, F.try_element_at(w, F.lit(4)).try_cast("double")).alias("score"), F.when(scored, F.try_element_at(w, F.lit(5)).try_cast("double")).alias("bls"),
    )


def read_codon_scores(spark: SparkSession, path: str | list[str], check: bool = True) -> DataFrame:
    """All codon scores of a path. check: an error if a file mixes strands or frames."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    df = parse_codon_scores(lines)
    if check:
        mixed = df.groupBy("file").agg(F.min("strand").alias("a"), F.max("strand").alias("b"), F.min("frame").alias("c"), F.max("frame").alias("d")).filter("a <> b or c <> d")
        if bad := mixed.select("file").take(1):
            raise ValueError(f"several strands or frames in {bad[0][0]}")
    return df.drop("file")


def is_bed_comment(value: Column | str) -> Column:
    v = F.ltrim(scalars.col(value))
    return (v == "") | v.startswith("#") | v.rlike(r"^(browser|track)(\s|$)")


def parse_bed(lines: DataFrame, value: str = "value") -> DataFrame:
    """BED6 to BED12 lines to 1-based closed intervals.

    Columns: chrom, start, stop, name, score, strand, thick_start, thick_stop (an empty range where there is none), rgb,
    blocks array<struct(start, stop)>, error (null, or why the line is malformed)."""
    raw = lines.select(F.split(F.regexp_replace(F.col(value), r"\s+$", ""), "\t").alias("f"), is_bed_comment(value).alias("_comment")).filter("not _comment")
    n = F.size("f")

    def field(i: int) -> Column:
        return F.try_element_at(F.col("f"), F.lit(i))

    def numbers(i: int) -> Column:
        return F.transform(F.split(F.regexp_replace(field(i), ",$", ""), ","), lambda x: x.try_cast("long"))

    lo, hi = field(2).try_cast("long"), field(3).try_cast("long")
    ts, te = field(7).try_cast("long"), field(8).try_cast("long")
    many = field(10).try_cast("int")
    zipped = F.transform(F.arrays_zip(numbers(11).alias("size"), numbers(12).alias("rel")), lambda z: F.struct((lo + 1 + z["rel"]).alias("start"), (lo + z["rel"] + z["size"]).alias("stop")))
    whole = F.array(F.struct((lo + 1).alias("start"), hi.alias("stop")))
    blocks = F.when(n >= 12, zipped).otherwise(whole)
    error = (
        F.when((n < 6) | n.isin(10, 11), F.concat_ws(" ", n.cast("string"), F.lit("fields")))
        .when(lo.isNull() | hi.isNull() | (lo >= hi), F.lit("bad interval"))
        .when((n >= 12) & ((F.size(numbers(11)) != many) | (F.size(numbers(12)) != many)), F.lit("block count"))
        .when((n >= 12) & (F.element_at(blocks, -1)["stop"] != hi), F.lit("last block ends elsewhere"))
    )
    error = F.when(~F.col("_comment"), error)  # filters of later steps may be tested before that of comments
    thick = (n > 6) & ts.isNotNull() & te.isNotNull() & (ts != te)
    return raw.select(
        field(1).alias("chrom"), (lo + 1).alias("start"), hi.alias("stop"), field(4).alias("name"), field(5).alias("score"), field(6).alias("strand"),
        F.when(thick, ts + 1).otherwise(F.lit(1).cast("long")).alias("thick_start"), F.when(thick, te).otherwise(F.lit(0).cast("long")).alias("thick_stop"),
        field(9).alias("rgb"), F.when(error.isNull(), blocks).alias("blocks"), error.alias("error"),
    )


def read_bed(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """parse_bed() of a path. strict: reading a malformed line is an error; else it comes with its error."""
    df = parse_bed(spark.read.text(path))
    if strict:
        return df.withColumn("blocks", F.when(F.col("error").isNull(), F.col("blocks")).otherwise(F.raise_error(F.concat(F.lit("BED line: "), F.col("error"))).cast(df.schema["blocks"].dataType))).drop("error")
    return df


def read_regions(spark: SparkSession, folder: str) -> DataFrame:
    """All region files of a folder (*.coding.bed, gzipped or not): rid, chrom, strand, start, stop.

    A length that is no multiple of three is an error."""
    df = read_bed(spark, f"{folder.rstrip('/')}/*.coding.bed*")
    whole = F.assert_true((F.col("stop") - F.col("start") + 1) % 3 == 0, F.concat(F.lit("not whole codons: "), F.col("name")))
    return df.filter(whole.isNull()).select(scalars.region_name("chrom", "start", "stop", "strand").alias("rid"), "chrom", "strand", "start", "stop")


def read_delimited(spark: SparkSession, path: str | list[str], sep: str = "\t", names: list[str] | None = None, comment: str = "#", allow_repeats: bool = False) -> DataFrame:
    """A delimited file of strings with a header, or with given names. Missing trailing fields are ''.

    Repeated names are an error unless allowed; then later ones get a number."""
    reader = spark.read.option("sep", sep).option("comment", comment).option("mode", "PERMISSIVE").option("quote", '"').option("emptyValue", "").option("nullValue", "\x00")
    if names is None:
        head = spark.read.text(path).filter((F.trim("value") != "") & ~F.col("value").startswith(comment)).first()
        names = [] if head is None else [x.strip().strip('"') for x in head[0].split(sep)]
        reader = reader.option("header", True).option("enforceSchema", True)
    if len(set(names)) < len(names):
        if not allow_repeats:
            raise ValueError("repeated field names")
        seen: dict[str, int] = {}
        for i, x in enumerate(names):
            seen[x] = seen.get(x, 0) + 1
            names[i] = x if seen[x] == 1 else f"{x}_{seen[x]}"
    df = reader.schema(T.StructType([T.StructField(x, T.StringType()) for x in names])).csv(path)
    return df.select(*[F.coalesce(F.col(f"`{x}`"), F.lit("")).alias(x) for x in names])


def apply_mappers(df: DataFrame, mappers: dict, keep_raw: bool = False) -> DataFrame:
    """Typed columns: a type name, or a function of a column. What can't be read as the type is null, and its text
    stays in <column>_raw if wanted."""
    out = {}
    for name, how in mappers.items():
        c = F.col(f"`{name}`")
        if keep_raw:
            out[f"{name}_raw"] = c
        out[name] = how(c) if callable(how) else c.try_cast(how)
    return df.withColumns(out)


def read_region_scores(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Region-level scores without header (region, strand, status, raw, bls): one row per region, the last in the file."""
    lines = numbered_lines(spark, path).withColumn("f", F.split("value", "\t")).filter(F.size("f") >= 3)
    where = F.element_at(scalars.parse_regions(F.col("f")[0]), 1)
    df = lines.select(
        where["chrom"].alias("chrom"), where["start"].alias("start"), where["stop"].alias("stop"), F.col("f")[1].alias("strand"), F.col("f")[2].alias("status"),
        F.try_element_at("f", F.lit(4)).try_cast("double").alias("raw"), F.try_element_at("f", F.lit(5)).try_cast("double").alias("bls"), F.struct("file", "line_no").alias("_at"),
    )
    return df.groupBy("chrom", "start", "stop", "strand").agg(F.max_by(F.struct("status", "raw", "bls"), "_at").alias("x")).select("chrom", "start", "stop", "strand", "x.*")


def read_coding_exons(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.option("sep", "\t").schema("chrom string, strand string, frame int, start long, stop long").csv(path)


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Sequence lines as chunks: name, offset (bases before), seq. Lines of one sequence stay apart; no row holds a whole genome.

    Each split of a file is numbered by itself. Only its lines before its first header belong to a sequence that began
    in an earlier split; name and bases of that come from a table of one row a split. Lines before any header have no name."""
    lines = numbered_lines(spark, path).withColumn("value", F.trim("value")).filter("value <> ''").select("file", "line_no.block", "line_no.row", "value")
    split = W.partitionBy("file", "block").orderBy("row")
    head = F.col("value").startswith(">")
    lines = lines.withColumn("part", F.sum(head.cast("int")).over(split))
    size = F.when(~head, F.length("value")).otherwise(0).cast("long")
    within = W.partitionBy("file", "block", "part").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("file", "block", "part")
    lines = lines.withColumns({"before": F.coalesce(F.sum(size).over(within), F.lit(0)), "own": F.max(F.when(head, F.trim(F.substring("value", 2, 1 << 20)))).over(whole)})
    ends = lines.groupBy("file", "block").agg(F.max_by("own", "part").alias("own"), F.max("part").alias("parts"), F.max_by(F.col("before") + size, F.struct("part", "row")).alias("bases"))
    files = W.partitionBy("file").orderBy("block")
    ends = ends.withColumn("run", F.sum((F.col("parts") > 0).cast("int")).over(files))
    ends = ends.withColumn("bases", F.sum("bases").over(W.partitionBy("file", "run").orderBy("block")))
    carried = ends.select("file", "block", F.last("own", ignorenulls=True).over(files.rowsBetween(W.unboundedPreceding, -1)).alias("old"), F.coalesce(F.lag("bases").over(files), F.lit(0)).alias("more"))
    seq = lines.filter(~head).join(carried, ["file", "block"])
    goes_on = F.col("part") == 0
    return seq.select(F.when(goes_on, F.col("old")).otherwise(F.col("own")).alias("name"), (F.col("before") + F.when(goes_on, F.col("more")).otherwise(0)).alias("offset"), F.col("value").alias("seq"))


def read_csv_table(spark: SparkSession, path: str | list[str], index: str | None = None, strict: bool = False) -> DataFrame:
    """A CSV table of strings with a header; cells are stripped, comments and blank lines skipped.

    Extra cells are dropped, or an error if strict. Rows without their index cell are left out."""
    reader = spark.read.option("header", True).option("comment", "#").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    df = reader.csv(path)
    return df.filter(F.col(f"`{index}`").isNotNull()) if index else df


def read_coefficients(spark: SparkSession, path: str, sizes: list[int]) -> DataFrame:
    """Little-endian doubles of one file, cut into arrays of the given sizes: arr, idx, coef. Another length is an error."""
    ship(spark)
    starts = np.concatenate(([0], np.cumsum(sizes)))

    def unpack(batches):
        for pdf in batches:
            for raw in pdf["content"]:
                x = np.frombuffer(raw, "<f8")
                if len(x) != starts[-1]:
                    raise ValueError(f"{len(x)} coefficients instead of {starts[-1]}")
                arr = np.repeat(np.arange(len(sizes)), sizes)
                yield pd.DataFrame({"arr": arr, "idx": np.arange(len(x)) - starts[arr], "coef": x})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "arr int, idx long, coef double")
