"""Transcripts as exon rows, and positions, reading frames and coding parts in their coordinates.

An exon row has tr_id, chrom, strand, idx (along the plus strand, from 1), start, stop, cum (bases of
earlier exons), len (bases of the transcript), cs and ce (coding start and end in transcript positions, or null).
Transcript positions count from 1 in the direction of the strand; outside they go on unspliced.

Positions meet one row a transcript, which holds its exons as an array, and find their exon by binary search in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codonweave.operators.intervals import overlap_join


def _plus() -> Column:
    return F.col("strand") == "+"


EXON = ["tr_id", "chrom", "strand", "idx", "start", "stop", "cum", "len", "cs", "ce"]


def with_lengths(exons: DataFrame) -> DataFrame:
    """tr_id, chrom, strand, start, stop to exon rows with idx, cum and len."""
    w = W.partitionBy("tr_id").orderBy("start")
    size = F.col("stop") - F.col("start") + 1
    return exons.withColumns({
        "idx": F.row_number().over(w).cast("long"),
        "cum": F.coalesce(F.sum(size).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "len": F.sum(size).over(W.partitionBy("tr_id")),
    })


def packed(exons: DataFrame) -> DataFrame:
    """One row a transcript: tr_id, and _tr with chrom, strand, len, cs, ce and exons, an array of (start, stop, cum) in order of starts."""
    one = [F.first(c).alias(c) for c in ("chrom", "strand", "len", "cs", "ce") if c in exons.columns]
    per = exons.groupBy("tr_id").agg(*one, F.array_sort(F.collect_list(F.struct("start", "stop", "cum"))).alias("exons"))
    return per.select("tr_id", F.struct(*[c for c in per.columns if c != "tr_id"]).alias("_tr"))


def _below(exons: Column, field: str, value: Column, equal: bool) -> Column:
    """How many exons of an array have a field below value (equal: or equal to it): a binary search, from the highest bit of the place."""
    n = F.size(exons)
    bits = F.filter(F.array(*[F.lit(1 << k) for k in range(24, -1, -1)]), lambda b: b <= n)

    def step(i: Column, b: Column) -> Column:
        at = F.try_element_at(exons, i + b)[field]
        return F.when((i + b <= n) & ((at <= value) if equal else (at < value)), i + b).otherwise(i)

    return F.aggregate(bits, F.lit(0), step)


def _exon(exons: Column, place: Column) -> Column:
    """The exon of a place from 1; the first one for place 0."""
    return F.try_element_at(exons, F.greatest(place, F.lit(1)))


def trpos_in(exons: Column, plus: Column, length: Column, pos: Column) -> Column:
    """The transcript position of a chromosome position; null in an intron."""
    at = _below(exons, "start", pos, True)
    return F.aggregate(
        F.array(at), F.lit(None).cast("long"),
        lambda _, i: F.when(
            (i == 0) | (i == F.size(exons)) | (pos <= _exon(exons, i)["stop"]),
            F.when(plus, _exon(exons, i)["cum"] + pos - _exon(exons, i)["start"] + 1).otherwise(length - _exon(exons, i)["cum"] - pos + _exon(exons, i)["start"]),
        ),
    )


def _met(rows: DataFrame, exons: DataFrame) -> DataFrame:
    """rows (tr_id, ...) with their transcript in _tr; those of transcripts that are not in exons are left out."""
    return rows.join(packed(exons), "tr_id").select(*[F.col(f"`{c}`") for c in rows.columns], "_tr")


def pos_to_trpos(positions: DataFrame, exons: DataFrame) -> DataFrame:
    """positions (tr_id, pos, ...) with trpos; null in an intron. Transcripts that are not in exons are left out; repeated rows stay as often as they stand there."""
    tr = F.col("_tr")
    return _met(positions, exons).withColumn("trpos", trpos_in(tr["exons"], tr["strand"] == "+", tr["len"], F.col("pos"))).drop("_tr")


def trpos_to_pos(positions: DataFrame, exons: DataFrame) -> DataFrame:
    """positions (tr_id, trpos, ...) with pos."""
    tr = F.col("_tr")
    rows = _met(positions, exons).withColumn("_u", F.when(tr["strand"] == "+", F.col("trpos")).otherwise(tr["len"] - F.col("trpos") + 1))
    rows = rows.filter("_u is not null").withColumn("_x", _exon(tr["exons"], _below(tr["exons"], "cum", F.col("_u"), False)))
    return rows.withColumn("pos", F.col("_x.start") - 1 + F.col("_u") - F.col("_x.cum")).drop("_tr", "_u", "_x")


def trinterval_to_intervals(spans: DataFrame, exons: DataFrame) -> DataFrame:
    """spans (tr_id, t_start, t_stop, ...) split at introns: one row with start and stop for each exon part.

    A span whose start is its end + 1 gives nothing."""
    tr = F.col("_tr")
    ex, plus = tr["exons"], tr["strand"] == "+"
    rows = _met(spans, exons).withColumns({
        "_lo": F.when(plus, F.col("t_start")).otherwise(tr["len"] - F.col("t_stop") + 1),
        "_hi": F.when(plus, F.col("t_stop")).otherwise(tr["len"] - F.col("t_start") + 1),
    }).filter("_lo <= _hi")
    rows = rows.withColumns({"_i": F.greatest(_below(ex, "cum", F.col("_lo"), False), F.lit(1)), "_j": F.greatest(_below(ex, "cum", F.col("_hi"), False), F.lit(1))})
    rows = rows.withColumn("_k", F.explode(F.sequence("_i", "_j"))).withColumn("_x", F.try_element_at(ex, F.col("_k")))
    size = F.col("_x.stop") - F.col("_x.start") + 1
    a = F.when(F.col("_k") == 1, F.col("_lo")).otherwise(F.greatest("_lo", F.col("_x.cum") + 1))
    b = F.when(F.col("_k") == F.size(ex), F.col("_hi")).otherwise(F.least("_hi", F.col("_x.cum") + size))
    shift = F.col("_x.start") - F.col("_x.cum") - 1
    return rows.select(*[F.col(f"`{c}`") for c in spans.columns], tr["chrom"].alias("chrom"), tr["strand"].alias("strand"), (shift + a).alias("start"), (shift + b).alias("stop"))


def transcripts_from_bed(bed: DataFrame) -> DataFrame:
    """Exon rows of read_bed() rows: cs and ce from the thick range where it is not empty; null if an edge lies in an intron.

    Each line is a transcript. tr_id is its name, and where several lines have one name, or none, its name, place, blocks' hash and number among equal lines;
    name stays beside it."""
    fields = [c for c in ("chrom", "start", "stop", "name", "strand", "thick_start", "thick_stop", "blocks") if c in bed.columns]
    lines = bed.groupBy(*fields).agg(F.count("*").cast("int").alias("_copies"))
    common = lines.groupBy("name").agg(F.sum("_copies").alias("_n")).filter("_n > 1 or name is null").withColumnRenamed("name", "_name")
    lines = lines.join(common, F.col("name").eqNullSafe(F.col("_name")), "left").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    ends = F.concat_ws("-", F.array_min("blocks.start").cast("string"), F.array_max("blocks.stop").cast("string"))
    place = F.concat(F.coalesce("name", F.lit("")), F.lit("|"), F.concat_ws(":", "chrom", ends, "strand", F.hex(F.xxhash64("blocks", "thick_start", "thick_stop")), F.col("_copy").cast("string")))
    ex = F.array_sort("blocks")
    # bases before each exon; a transcript has few
    cums = F.transform(ex, lambda x, i: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), F.aggregate(F.slice(ex, F.lit(1), i), F.lit(0).cast("long"), lambda n, y: n + y["stop"] - y["start"] + 1).alias("cum")))
    length = F.aggregate(ex, F.lit(0).cast("long"), lambda n, y: n + y["stop"] - y["start"] + 1)
    rows = lines.select(F.when(F.col("_n").isNull(), F.col("name")).otherwise(place).alias("tr_id"), "name", "chrom", "strand", "thick_start", "thick_stop", cums.alias("_ex"), length.alias("len"))
    plus = F.col("strand") == "+"
    a, b = (trpos_in(F.col("_ex"), plus, F.col("len"), F.col(c)) for c in ("thick_start", "thick_stop"))
    both = (F.col("thick_start") <= F.col("thick_stop")) & F.col("_a").isNotNull() & F.col("_b").isNotNull()
    rows = rows.withColumns({"_a": a, "_b": b}).withColumns({"cs": F.when(both, F.least("_a", "_b")), "ce": F.when(both, F.greatest("_a", "_b"))})
    flat = rows.select("tr_id", "chrom", "strand", "len", "cs", "ce", "name", F.posexplode("_ex").alias("_i", "_x"))
    return flat.withColumns({"idx": (F.col("_i") + 1).cast("long"), "start": F.col("_x.start"), "stop": F.col("_x.stop"), "cum": F.col("_x.cum")}).select(*EXON, "name")


def left_out(exons: DataFrame) -> DataFrame:
    """One row: transcripts, and how many of them have no coding range, so that nothing of them counts as coding."""
    per = exons.groupBy("tr_id").agg(F.max("cs").alias("cs"))
    return per.agg(F.count("*").alias("transcripts"), F.count(F.when(F.col("cs").isNull(), 1)).alias("without_coding"))


def exon_intervals(exons: DataFrame) -> DataFrame:
    return exons.select("tr_id", "chrom", "strand", "idx", "start", "stop")


def intron_intervals(exons: DataFrame) -> DataFrame:
    w = W.partitionBy("tr_id").orderBy("start")
    gap = exons.select("tr_id", "chrom", "strand", "idx", (F.col("stop") + 1).alias("start"), (F.lead("start").over(w) - 1).alias("stop"))
    return gap.filter("stop is not null")


def cds_spans(exons: DataFrame, include_stop: bool = True, trim: int | None = None) -> DataFrame:
    """(tr_id, t_start, t_stop) of each coding transcript; trim: offset to which both ends are brought to codon boundaries."""
    per = exons.filter("cs is not null and ce is not null").select("tr_id", "cs", "ce").distinct()
    out = per.select("tr_id", "cs", F.col("cs").alias("t_start"), (F.col("ce") - (0 if include_stop else 3)).alias("t_stop"))
    if trim is not None:
        a, b = trim_to_codons("t_start", "t_stop", "cs", trim)
        out = out.withColumns({"t_start": a, "t_stop": b}).filter("t_start is not null")
    return out.filter("t_start <= t_stop").select("tr_id", "t_start", "t_stop")


def trim_to_codons(start: str, stop: str, cs: str, offset: int = 0) -> tuple[Column, Column]:
    """Both ends of a transcript interval moved inwards to codon boundaries; null where nothing is left.

    From a position to the next codon start it is its distance to any codon start, modulo 3, and likewise back to a codon end."""
    first = F.col(cs) + offset
    a = F.col(start) + F.pmod(first - F.col(start), F.lit(3))
    b = F.col(stop) - F.pmod(F.col(stop) - (first + 2), F.lit(3))
    return F.when(a < b, a), F.when(a < b, b)


def cds_intervals(exons: DataFrame, include_stop: bool = True, trim: int | None = None) -> DataFrame:
    """(tr_id, chrom, strand, start, stop) of the coding parts, split at introns; the stop codon is cut in transcript positions."""
    return trinterval_to_intervals(cds_spans(exons, include_stop, trim), exons).select("tr_id", "chrom", "strand", "start", "stop")


def frame_of_trpos(trpos: Column, cs: Column) -> Column:
    return F.pmod(trpos - cs, F.lit(3))


def frame_of_base(positions: DataFrame, exons: DataFrame) -> DataFrame:
    """positions (tr_id, pos, ...) with frame; null in introns and for transcripts without coding part."""
    tr = F.col("_tr")
    trpos = trpos_in(tr["exons"], tr["strand"] == "+", tr["len"], F.col("pos"))
    return _met(positions, exons).withColumn("frame", frame_of_trpos(trpos, tr["cs"])).drop("_tr")


def tr_num_codons(exons: DataFrame, include_stop: bool = True) -> DataFrame:
    size = F.col("ce") - F.col("cs") + 1 - (0 if include_stop else 3)
    return exons.filter("cs is not null").select("tr_id", F.floor(size / 3).cast("long").alias("codons")).distinct()


def same_or_anti_frame(f1: Column, strand1: Column, f2: Column, strand2: Column) -> Column:
    """Whether two transcripts read a base in one frame, or in the antisense frame if strands differ; null if a frame is."""
    return F.when(strand1 == strand2, f1 == f2).otherwise(f1 == F.pmod(1 - f2, F.lit(3)))


def coding_phase(exons: DataFrame) -> Column:
    """pmod of codon starts (+) or codon ends (-) on the chromosome, for an exon row's coding frame."""
    plus = F.pmod(F.col("start") + F.col("cs") - F.col("cum") - 1, F.lit(3))
    minus = F.pmod(F.col("len") + F.col("start") - F.col("cum") - F.col("cs"), F.lit(3))
    return F.when(_plus(), plus).otherwise(minus)


def cds_with_phase(exons: DataFrame, include_stop: bool) -> DataFrame:
    """Coding parts with their phase: tr_id, chrom, strand, start, stop, phase.

    bare_start, bare_stop: the part without the stop codon; the start is greater where nothing of it is left."""
    shift, size = F.col("start") - F.col("cum") - 1, F.col("stop") - F.col("start") + 1

    def ends(hi: Column) -> tuple[Column, Column]:
        lo_u = F.when(_plus(), F.col("cs")).otherwise(F.col("len") - hi + 1)
        hi_u = F.when(_plus(), hi).otherwise(F.col("len") - F.col("cs") + 1)
        return shift + F.greatest(lo_u, F.col("cum") + 1), shift + F.least(hi_u, F.col("cum") + size)

    bare = ends(F.col("ce") - 3)
    a, b = ends(F.col("ce")) if include_stop else bare
    cut = exons.filter("cs is not null and ce is not null")
    cut = cut.select("tr_id", "chrom", "strand", coding_phase(exons).alias("phase"), a.alias("a"), b.alias("b"), bare[0].alias("bare_start"), bare[1].alias("bare_stop"))
    return cut.filter("a <= b").withColumnsRenamed({"a": "start", "b": "stop"})


def intersect_transcripts(a: DataFrame, b: DataFrame, same_strand: bool = False, same_frame: bool = False) -> DataFrame:
    """Overlaps of two sets of coding parts (from cds_with_phase), pairwise by transcript.

    same_frame: only overlaps that both read in one frame (antisense frame on opposite strands), judged at the
    first base of the overlap; within one exon part the frame does not change."""
    right = b.select("chrom", "start", "stop", F.col("tr_id").alias("tr_id2"), F.col("strand").alias("strand2"), F.col("phase").alias("phase2"))
    pairs = overlap_join(a.select("tr_id", "chrom", "strand", "start", "stop", "phase"), right, ["chrom"]).filter("tr_id <> tr_id2")
    if same_strand:
        pairs = pairs.filter("strand = strand2")
    base = F.greatest("start", "b_start")
    f1 = F.when(F.col("strand") == "+", F.pmod(base - F.col("phase"), F.lit(3))).otherwise(F.pmod(F.col("phase") - base, F.lit(3)))
    f2 = F.when(F.col("strand2") == "+", F.pmod(base - F.col("phase2"), F.lit(3))).otherwise(F.pmod(F.col("phase2") - base, F.lit(3)))
    if same_frame:
        pairs = pairs.filter(same_or_anti_frame(f1, F.col("strand"), f2, F.col("strand2")))
    return pairs.select("tr_id", "tr_id2", "chrom", base.alias("o_start"), F.least("stop", "b_stop").alias("o_stop")).withColumnsRenamed({"o_start": "start", "o_stop": "stop"})
