"""Transcript coordinates, frames and coding parts over derived exons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonweave.operators import transcripts as T
from codonweave.plans.inputs import derived, with_inputs
from codonweave.plans.registry import query

_EX = with_inputs("exons")


@query(_EX + " select tr_id, chrom, strand, idx, start, stop, cum, len from exons")
def exon_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.with_lengths(derived(spark, sf_dir, "exons").select("tr_id", "chrom", "strand", "start", "stop"))


@query(_EX + " select tr_id, chrom, strand, idx, start, stop from exons")
def exon_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.exon_intervals(derived(spark, sf_dir, "exons"))


@query(_EX + " select * from (select tr_id, chrom, strand, idx, stop + 1 as start, lead(start) over (partition by tr_id order by start) - 1 as stop from exons) where stop is not null")
def introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.intron_intervals(derived(spark, sf_dir, "exons"))


def _cut(lo: str, hi: str) -> str:
    """SQL for the exon parts between two transcript positions."""
    return f"""select tr_id, chrom, strand, greatest(a, cum + 1) + start - cum - 1 as start, least(z, cum + stop - start + 1) + start - cum - 1 as stop from (
        select *, case when strand = '+' then {lo} else len - {hi} + 1 end as a, case when strand = '+' then {hi} else len - {lo} + 1 end as z from exons) where greatest(a, cum + 1) <= least(z, cum + stop - start + 1)"""


@query(_EX + " " + _cut("cs", "ce"))
def cds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cds_intervals(derived(spark, sf_dir, "exons"))


@query(_EX + " " + _cut("cs", "(ce - 3)"))
def cds_without_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cds_intervals(derived(spark, sf_dir, "exons"), include_stop=False)


@query(_EX + " " + _cut("(cs + 1)", "(ce - 2)"))
def cds_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cds_intervals(derived(spark, sf_dir, "exons"), trim=1)


@query(_EX + " select distinct tr_id, ((ce - cs + 1) // 3)::bigint as codons from exons")
def tr_num_codons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tr_num_codons(derived(spark, sf_dir, "exons"))


#: Positions around each transcript: before it, in its exons and introns, and after it.
_POSITIONS = "select tr_id, pos from (select tr_id, unnest([min(start) - 5, min(start) + 7, min(stop) + 4, max(stop) - 3, max(stop) + 6]) as pos from exons group by tr_id)"


def _positions(exons: DataFrame) -> DataFrame:
    a, b, c = F.min("start"), F.min("stop"), F.max("stop")
    return exons.groupBy("tr_id").agg(F.array(a - 5, a + 7, b + 4, c - 3, c + 6).alias("p")).select("tr_id", F.explode("p").alias("pos"))


_TRPOS = f"""p as ({_POSITIONS}), ends as (select tr_id, min(start) as s, max(stop) as e from exons group by tr_id),
    hit as (select p.tr_id, p.pos, max(case when x.strand = '+' then u else x.len - u + 1 end) as trpos from p join ends using (tr_id)
        left join (select tr_id as t, * from exons) x on x.t = p.tr_id and (p.pos between x.start and x.stop or (x.start = ends.s and p.pos < x.start) or (x.stop = ends.e and p.pos > x.stop)),
        lateral (select x.cum + p.pos - x.start + 1 as u) group by p.tr_id, p.pos)"""


@query(_EX + ", " + _TRPOS + " select tr_id, pos, trpos::double as trpos from hit")
def pos_to_trpos(spark: SparkSession, sf_dir: str) -> DataFrame:
    exons = derived(spark, sf_dir, "exons")
    return T.pos_to_trpos(_positions(exons).distinct(), exons).withColumn("trpos", F.col("trpos").cast("double"))  # nulls in introns


@query(_EX + ", " + _TRPOS + " select distinct tr_id, pos, (((trpos - cs) % 3 + 3) % 3)::double as frame from hit join exons using (tr_id)")
def base_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    exons = derived(spark, sf_dir, "exons")
    return T.frame_of_base(_positions(exons).distinct(), exons).withColumn("frame", F.col("frame").cast("double"))


@query(_EX + """, q as (select tr_id, unnest([-4, 1, len // 2, len, len + 9]) as trpos from (select distinct tr_id, len from exons)), ends as (select tr_id, min(idx) as f, max(idx) as l from exons group by tr_id)
    select tr_id, trpos, e.stop + u - (e.cum + e.stop - e.start + 1) as pos from (select e.*, q.trpos, case when strand = '+' then trpos else len - trpos + 1 end as u, f, l from q join exons e using (tr_id) join ends using (tr_id)) e
    where (idx = f or u > cum) and (idx = l or u <= cum + stop - start + 1)""")
def trpos_to_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    exons = derived(spark, sf_dir, "exons")
    n = F.col("len")
    asked = exons.select("tr_id", "len").distinct().select("tr_id", F.explode(F.array(F.lit(-4).cast("long"), F.lit(1).cast("long"), F.floor(n / 2), n, n + 9)).alias("trpos"))
    return T.trpos_to_pos(asked, exons)


@query(_EX + " " + _cut("(len // 4 + 1)", "(len // 2)"))
def trinterval_to_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    exons = derived(spark, sf_dir, "exons")
    spans = exons.select("tr_id", "len").distinct().select("tr_id", (F.floor(F.col("len") / 4) + 1).alias("t_start"), F.floor(F.col("len") / 2).alias("t_stop"))
    return T.trinterval_to_intervals(spans, exons).select("tr_id", "chrom", "strand", "start", "stop")


#: Coding parts with the frame of their first base on the chromosome.
PARTS = "select c.tr_id, c.chrom, c.strand, c.start, c.stop, (((case when e.strand = '+' then e.cum + c.start - e.start + 1 else e.len - (e.cum + c.start - e.start) end) - e.cs) % 3 + 3) % 3 as f from ({cut}) c join exons e on e.tr_id = c.tr_id and c.start between e.start and e.stop"
_PARTS = PARTS.format(cut=_cut("cs", "(ce - 3)"))


def _overlaps(own: str) -> str:
    step = "case when {x}.strand = '+' then ({x}.f + greatest(a.start, b.start) - {x}.start) % 3 else ((({x}.f - (greatest(a.start, b.start) - {x}.start)) % 3) + 3) % 3 end"
    return _EX + f""", parts as ({_PARTS}), pairs as (select a.tr_id, b.tr_id as tr_id2, a.chrom, greatest(a.start, b.start) as start, least(a.stop, b.stop) as stop, a.strand as s1, b.strand as s2, {step.format(x='a')} as f1, {step.format(x='b')} as f2
        from parts a join parts b on a.chrom = b.chrom and a.start <= b.stop and b.start <= a.stop and a.tr_id <> b.tr_id)
    select tr_id, tr_id2, chrom, start, stop from pairs where {own}"""


@query(_overlaps("(s1 = s2 and f1 = f2) or (s1 <> s2 and f1 = ((1 - f2) % 3 + 3) % 3)"))
def transcript_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = T.cds_with_phase(derived(spark, sf_dir, "exons"), include_stop=False)
    return T.intersect_transcripts(parts, parts, same_frame=True)


@query(_overlaps("s1 = s2"))
def transcript_overlaps_any_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = T.cds_with_phase(derived(spark, sf_dir, "exons"), include_stop=False)
    return T.intersect_transcripts(parts, parts, same_strand=True)
