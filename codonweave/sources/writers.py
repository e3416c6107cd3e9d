"""Lines and tables in the formats that browsers and outside tools read."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonweave.functions import scalars


def _or(name: str, value: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(value))


def _line(columns: list[Column]) -> Column:
    """Fields between tabs; null if any is, so that no field moves to another's place."""
    return F.concat(*[x for c in columns for x in (F.lit("\t"), c.cast("string"))][1:])


def bed12_line(df: DataFrame) -> Column:
    """A BED12 line from chrom, name, score, strand, thick_start, thick_stop, rgb and blocks (1-based closed).

    A null name or strand is written as '.', a null score or colour as 0, and a thick range that is null or empty as none. A row
    without chromosome or blocks gives null."""
    first = F.element_at("blocks", 1)["start"] - 1
    sizes = F.array_join(F.transform("blocks", lambda b: (b["stop"] - b["start"] + 1).cast("string")), ",")
    rel = F.array_join(F.transform("blocks", lambda b: (b["start"] - 1 - first).cast("string")), ",")
    thick = F.coalesce(F.col("thick_start") <= F.col("thick_stop"), F.lit(False))
    columns = [
        F.col("chrom"), first, F.element_at("blocks", -1)["stop"], _or("name", "."), _or("score", "0"), _or("strand", "."),
        F.when(thick, F.col("thick_start") - 1).otherwise(first), F.when(thick, F.col("thick_stop")).otherwise(first), _or("rgb", "0"), F.size("blocks"), sizes, rel,
    ]
    return _line(columns)


def to_bed12(df: DataFrame) -> DataFrame:
    return df.select(bed12_line(df).alias("value"))


def bed9_line(regions: DataFrame) -> Column:
    """A line of regions (chrom, strand, start, stop, gray): the whole region thick, in grey.

    A null strand is written as '.', a null grey as 0; a row without place gives null."""
    lo, gray = F.col("start") - 1, _or("gray", "0")
    fields = [F.col("chrom"), lo, F.col("stop"), scalars.region_string("chrom", "start", "stop"), F.lit("0"), _or("strand", "."), lo, F.col("stop"), F.concat_ws(",", gray, gray, gray)]
    return _line(fields)


def to_bed9(regions: DataFrame) -> DataFrame:
    return regions.select(bed9_line(regions).alias("value"))


def write_lines(lines: DataFrame, path: str, by: list[str] | None = None, gzip: bool = False) -> None:
    """A text file per task (or per value of the columns `by`) of the column value."""
    writer = lines.write.option("compression", "gzip" if gzip else "none")
    (writer.partitionBy(*by) if by else writer).text(path)


def write_in_order(lines: DataFrame, path: str, order: list[str | Column], gzip: bool = False) -> None:
    """The column value of lines as a folder of text files which, in the order of their names, hold them in order.

    Rows are dealt by range and sorted, so each task writes a stretch; readers.read_in_order() numbers such lines again."""
    laid = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    write_lines(laid.select("value"), path, gzip=gzip)


def write_regions(regions: DataFrame, folder: str, gzip: bool = False) -> None:
    """BED9 lines of regions (chrom, strand, start, stop, gray) in folder, by chromosome, strand and frame, in order of starts.

    Each is a folder '<chrom>.Strand<strand>.Frame<frame>.coding.bed' of part files, as readers.read_regions() takes them; a row without place is left out. Parts are written to a
    folder of their own first and then named, so a job that fails leaves no half region files."""
    spark = regions.sparkSession
    name = F.concat(F.col("chrom"), F.lit(".Strand"), F.col("strand"), F.lit(".Frame"), scalars.frame("start").cast("string"), F.lit(".coding.bed"))
    lines = regions.select(name.alias("file"), "start", "stop", bed9_line(regions).alias("value")).filter("value is not null")
    laid = lines.repartitionByRange("file", "start", "stop").sortWithinPartitions("file", "start", "stop").select("file", "value")
    stage = f"{folder.rstrip('/')}/_stage"
    write_lines(laid, stage, by=["file"], gzip=gzip)
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(stage)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    for entry in fs.listStatus(top):  # one a chromosome, strand and frame
        if entry.isDirectory():
            own = unquote(entry.getPath().getName().removeprefix("file="))
            goal = jvm.org.apache.hadoop.fs.Path(top.getParent(), own)
            if fs.exists(goal) or not fs.rename(entry.getPath(), goal):
                raise FileExistsError(f"{folder}/{own}")
    fs.delete(top, True)


def write_requests(regions: DataFrame, path: str, order: list[str]) -> None:
    """Lines 'region<tab>strand' for the outside scorer, in the order of regions: each region's own line, then its antisense line."""
    x = scalars.anti_interval("start", "stop", "strand")
    lines = F.array(
        _line([scalars.region_string("chrom", "start", "stop"), F.col("strand")]),
        _line([scalars.region_string("chrom", x["start"], x["stop"]), x["strand"]]),
    )
    write_in_order(regions.select(*order, F.posexplode(lines).alias("_part", "value")), path, [*order, "_part"])


def write_delimited(df: DataFrame, path: str, fields: list[str] | None = None, sep: str = "\t", header: bool = True) -> None:
    """Columns in a fixed order; missing values are empty and text stays as it is."""
    df.select(*(fields or df.columns)).write.option("sep", sep).option("header", header).option("emptyValue", "").option("nullValue", "").option("quote", "\x00").csv(path)


def write_csv_table(df: DataFrame, path: str, index: str) -> None:
    """A CSV table with its index column first."""
    df.select(index, *[c for c in df.columns if c != index]).write.option("header", True).csv(path)


def to_fasta_lines(df: DataFrame, width: int | None = 70) -> DataFrame:
    """name, line_no, value: a header and lines of `width` letters (None: one line) for each name and seq."""
    if width is None:
        parts = F.array("seq")
    else:
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("seq") / width) - 1, F.lit(0)).cast("int")), lambda i: F.substring(F.col("seq"), i * width + 1, F.lit(width)))
    lines = F.concat(F.array(F.concat(F.lit(">"), F.col("name"))), parts)
    return df.select("name", F.posexplode(lines).alias("line_no", "value"))
