"""Classification, scoring and ranking of derived regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonweave.functions import scalars as S
from codonweave.operators import compare, regions, scoring, transcripts
from codonweave.operators.transcripts import cds_with_phase
from codonweave.plans.inputs import derived, derived_by, on_tables, with_inputs
from codonweave.plans.registry import query
from codonweave.plans.transcript_queries import _cut, PARTS
from codonweave.session import materialize, once, scratch, shared_folder
from codonweave.sources import readers, writers

#: Coding transcripts are all but every tenth; those are the pseudogenes.
_KINDS = "coding as (select * from exons where tr_id % 10 <> 0), pseudo as (select * from exons where tr_id % 10 = 0)"
_IN = with_inputs("regions", "exons") + ", " + _KINDS


def _parts(name: str, hi: str, exons: str = "coding") -> str:
    """Coding parts with the phase that a codon-aligned region in their frame has."""
    cut = _cut("cs", hi).replace("from exons", f"from {exons}")
    body = PARTS.format(cut=cut).replace("join exons e", f"join {exons} e")
    return f"{name}_f as ({body}), {name} as (select tr_id, chrom, strand, start, stop, case when strand = '+' then ((start - f) % 3 + 3) % 3 else (start + f) % 3 end as phase from {name}_f)"


_PHASE = "case when {s} = '+' then ((r.start{d}) % 3 + 3) % 3 else ((r.stop{d}) % 3 + 3) % 3 end"
_SAME = "select r.rid, c.tr_id, greatest(r.start, c.start) as b, least(r.stop, c.stop) as z from regions r join {t} c on r.chrom = c.chrom and r.strand = c.strand and r.start <= c.stop and c.start <= r.stop and c.phase = case when r.strand = '+' then r.start % 3 else r.stop % 3 end"
_ANTI = """select r.rid, c.tr_id, greatest(r.start, c.start) as b, least(r.stop, c.stop) as z from (select rid, chrom, case when strand = '+' then '-' else '+' end as strand,
    start + case when strand = '+' then 2 else -2 end as start, stop + case when strand = '+' then 2 else -2 end as stop from regions) r
    join {t} c on r.chrom = c.chrom and r.strand = c.strand and r.start <= c.stop and c.start <= r.stop and c.phase = case when r.strand = '+' then r.start % 3 else r.stop % 3 end"""
_CLASS = f"""{_parts('c0', '(ce - 3)')}, near as (select distinct r.rid, c.tr_id from regions r join c0 c on r.chrom = c.chrom and r.start <= c.stop and c.start <= r.stop),
    ps as (select r.rid, e.start as b, e.stop as z from regions r join pseudo e on r.chrom = e.chrom and r.start <= e.stop and e.start <= r.stop),
    cls as (select r.*, case when rid in (select rid from ps) then 'PseudoOverlap' when rid in (select rid from ({_SAME.format(t='c0')}) join near using (rid, tr_id)) then 'CodingOverlap'
        when rid in (select rid from ({_ANTI.format(t='c0')}) join near using (rid, tr_id)) then 'AntisenseOverlap' else 'NoOverlap' end as reg_type from regions r)"""
_EXT = f"""{_parts('c1', 'ce')}, cut as (select rid, b, z from ps union all select rid, b, z from ({_SAME.format(t='c1')}) join near using (rid, tr_id) union all select rid, b, z from ({_ANTI.format(t='c1')}) join near using (rid, tr_id)),
    wide as (select r.rid, r.chrom, r.strand, r.start, r.stop, b - (((b - r.start) % 3 + 3) % 3) as b, z + (((r.stop - z) % 3 + 3) % 3) as z from cls r left join cut using (rid) where reg_type <> 'NoOverlap'),
    steps as (select *, max(z) over (partition by rid order by b, z rows between unbounded preceding and 1 preceding) as reach from wide),
    ext as (select rid, chrom, strand, greatest(coalesce(reach + 1, start), start) as start, least(coalesce(b - 1, stop), stop) as stop from steps
        union all select rid, chrom, strand, max(z) + 1, any_value(stop) from wide where z is not null group by rid, chrom, strand),
    extension as (select * from ext where start <= stop)"""


def _kinds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    regions, exons = (once(derived(spark, sf_dir, name)) for name in ("regions", "exons"))  # several steps read them
    return regions, exons.filter("tr_id % 10 <> 0"), exons.filter("tr_id % 10 = 0")


@query(_IN + f", {_parts('c1', 'ce', 'exons')} select rid, tr_id, b as c_start, z as c_stop from ({_SAME.format(t='c1')})")
def same_frame_cds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.same_frame_cds(derived(spark, sf_dir, "regions"), cds_with_phase(derived(spark, sf_dir, "exons"), True))


@query(_IN + f", {_parts('c0', '(ce - 3)', 'exons')} select distinct rid, tr_id from ({_ANTI.format(t='c0')})")
def anti_frame_cds(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg, exons = derived(spark, sf_dir, "regions"), derived(spark, sf_dir, "exons")
    return regions.same_frame_cds(regions.antisense(reg), cds_with_phase(exons, False)).select("rid", "tr_id").distinct()


@query(_IN + ", " + _CLASS + " select rid, chrom, strand, start, stop, reg_type from cls")
def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.classify(*_kinds(spark, sf_dir))


@query(_IN + ", " + _CLASS + ", " + _EXT + " select rid, chrom, strand, start, stop from extension")
def extension_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.extensions(*_kinds(spark, sf_dir)).drop("p_start", "p_stop")


_NAME = "chrom || ':' || start || '-' || stop || ':' || strand"


@query(_IN + ", " + _CLASS + ", " + _EXT + f""" select rid, {_NAME} as name, reg_type, chrom, start, stop, strand, null::varchar as parent, (stop - start + 1) // 3 as num_codons from cls
    union all select e.rid, e.chrom || ':' || e.start || '-' || e.stop || ':' || e.strand, 'Extension', e.chrom, e.start, e.stop, e.strand, c.chrom || ':' || c.start || '-' || c.stop || ':' || c.strand, (e.stop - e.start + 1) // 3 from extension e join cls c using (rid)""")
def classify_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch() as keep:
        rows = keep(regions.classified(*_kinds(spark, sf_dir)))
    return regions.sorted_regions(rows)


@query(with_inputs("regions") + """ select rid, 0 as part, chrom || ':' || start || '-' || stop as region, strand from regions
    union all select rid, 1, chrom || ':' || (start + case when strand = '+' then 2 else -2 end) || '-' || (stop + case when strand = '+' then 2 else -2 end), case when strand = '+' then '-' else '+' end from regions""")
def scoring_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.region_scoring_requests(derived(spark, sf_dir, "regions"))


@query(with_inputs("regions") + """, lines as (select rid, 0 as part, chrom || ':' || start || '-' || stop || chr(9) || strand as value from regions
    union all select rid, 1, chrom || ':' || (start + case when strand = '+' then 2 else -2 end) || '-' || (stop + case when strand = '+' then 2 else -2 end) || chr(9) || case when strand = '+' then '-' else '+' end from regions)
    select row_number() over (order by rid, part) as line_no, value from lines""")
def scoring_request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outside scorer's lines in the order of records, through files that the reader numbers again."""
    path = shared_folder(spark)
    writers.write_requests(derived(spark, sf_dir, "regions"), path, ["rid"])
    return readers.read_in_order(spark, path).select("line_no", "value")


@query(with_inputs("exons") + " select count(*) as transcripts, count(*) filter (cs is null) as without_coding from (select tr_id, max(case when tr_id % 10 <> 0 then cs end) as cs from exons group by tr_id)")
def transcripts_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many transcripts have no coding range; those of the pseudogenes' numbers lose theirs beforehand."""
    exons = derived(spark, sf_dir, "exons")
    return transcripts.left_out(exons.withColumn("cs", F.when(F.col("tr_id") % 10 != 0, F.col("cs"))))


_SCORED = """keyed as (select chrom, start, stop, strand, max(status) as status, max(raw) as raw, max(bls) as bls from scores group by all),
    joined as (select r.*, (r.stop - r.start + 1) // 3 as n, a.raw, a.bls, b.raw as other from regions r left join keyed a using (chrom, start, stop, strand)
        left join keyed b on b.chrom = r.chrom and b.start = r.start + case when r.strand = '+' then 2 else -2 end and b.stop = r.stop + case when r.strand = '+' then 2 else -2 end
            and b.strand = case when r.strand = '+' then '-' else '+' end and b.status not in ('No_Alignment', 'failure'))"""


def _keyed(scores: DataFrame) -> DataFrame:
    """One row of each (chrom, start, stop, strand)."""
    keys = ["chrom", "start", "stop", "strand", "_by"]
    return scores.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("status", "raw", "bls")])


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = derived(spark, sf_dir, "regions")
    return scoring.add_score_fields(own, derived_by(spark, sf_dir, "scores", "lineitem", "l_orderkey"), _keyed)


@query(with_inputs("regions", "scores") + ", " + _SCORED + " select rid, round(coalesce(bls, -1), 8) as bls, round(coalesce(raw / n, -1), 8) as score_per_codon, round(coalesce(other / n, -1), 8) as anti_score_per_codon, round(coalesce(raw / n - coalesce(other / n, 0), -1), 8) as score_diff from joined")
def score_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("rid", *[F.round(F.coalesce(c, F.lit(-1.0)), 8).alias(c) for c in ("bls", "score_per_codon", "anti_score_per_codon", "score_diff")])


@query(with_inputs("regions", "scores") + ", " + _SCORED + " select count(*) as regions, count(*) filter (raw is null) as without_score, count(*) filter (other is null) as without_antisense from joined")
def unscored_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.unscored(_scored(spark, sf_dir))


@query()
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.stratified_sample(derived(spark, sf_dir, "features"), "reg_type", 500, F.col("rid"), seed=3).select("rid", "reg_type")


@query()
def rbf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.add_svm_scores(derived(spark, sf_dir, "features"), 500, F.col("rid"))
    return scored.select("rid", F.round("svm_score", 4).alias("svm_score"), F.round("svm_antisense_score", 4).alias("svm_antisense_score"))


@query()
def candidate_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only rows that can be candidates or be learned from are scored; tables go as soon as the next is written."""
    with scratch() as keep:
        with scratch() as hold:
            table = hold(regions.classified(*_kinds(spark, sf_dir), scoring.of_use()))
        table = regions.named(table).drop("name", "parent")
        joined = keep(scoring.joined_scores(table, derived_by(spark, sf_dir, "scores", "lineitem", "l_orderkey"), _keyed, written=True))
    name = S.region_name("chrom", "start", "stop", "strand").alias("name")
    return scoring.best(scoring.with_score_fields(joined), 200).select("rank", "rid", name, "reg_type", "chrom", "start", "stop", "strand")


#: Made-up scores, so that ranking alone is compared.
_FAKE = "select distinct rid, chrom, strand, start, stop, num_codons, 'NoOverlap' as reg_type, score_diff / 10 as svm_antisense_score, cast(floor(score_per_codon) as bigint) % 7 as svm_score from features"
_RANKED = f"fake as ({_FAKE}), ranked as (select *, row_number() over (order by svm_score desc, chrom, strand, start, stop, rid) as rank from fake where num_codons >= 9 and svm_antisense_score >= 0.05)"


def _fake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_tables(spark, _FAKE, {"features": derived(spark, sf_dir, "features")})


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = scoring.candidate_filter(_fake(spark, sf_dir), min_antisense=0.05)
    order = [F.desc("svm_score"), F.asc("chrom"), F.asc("strand"), F.asc("start"), F.asc("stop"), F.asc("rid")]
    return scoring.global_rank(kept, order)


@query(with_inputs("features") + f", {_RANKED} select rid, svm_score, rank from ranked")
def rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("rid", "svm_score", "rank")


@query(with_inputs("features") + f""", {_RANKED}, n as (select count(*)::double as n from ranked), b as (select *, case when n = 10000 then (rank - 1) / n when 1 + (n - 10000) / 25000000 * n <= 0 then 0 else ln(1 + (n - 10000) / 25000000 * (rank - 1)) / ln(1 + (n - 10000) / 25000000 * n) end as s from ranked, n),
    c as (select *, floor(8 * s) / 8 as p from b) select rid, rank, case when strand = '+' then floor(255 * p)::bigint || ',' || floor(175 * (1 - p) + 255 * p)::bigint || ',' || floor(255 * p)::bigint
        else floor(200 * (1 - p) + 255 * p)::bigint || ',' || floor(255 * p)::bigint || ',' || floor(255 * p)::bigint end as rgb from c""")
def candidate_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = materialize(_ranked(spark, sf_dir))
    return scoring.candidates_bed(ranked, ranked.count()).select(F.col("name").cast("long").alias("rank"), "rgb").join(ranked.select("rank", "rid"), "rank")


@query(with_inputs("features") + f", {_RANKED} select chrom || chr(9) || (start - 1) || chr(9) || stop || chr(9) || rid || chr(9) || '0' || chr(9) || strand || chr(9) || (start - 1) || chr(9) || stop || chr(9) || '0,0,0' || chr(9) || '1' || chr(9) || (stop - start + 1) || chr(9) || '0' as value from ranked")
def bed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.array(F.struct("start", "stop"))
    df = _ranked(spark, sf_dir).select("chrom", F.col("rid").alias("name"), F.lit(0).alias("score"), "strand", F.col("start").alias("thick_start"), F.col("stop").alias("thick_stop"), F.lit("0,0,0").alias("rgb"), one.alias("blocks"))
    return writers.to_bed12(df)


@query(with_inputs("features") + """ select distinct chrom || chr(9) || (start - 1) || chr(9) || stop || chr(9) || chrom || ':' || start || '-' || stop || chr(9) || '0' || chr(9) || strand || chr(9) || (start - 1) || chr(9) || stop || chr(9) || g || ',' || g || ',' || g as value
    from (select *, case when score_diff < 1 then 210 when score_diff > 7 then 0 else 210 - 30 * floor(score_diff) end::bigint as g from features)""")
def region_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = derived(spark, sf_dir, "features").withColumn("gray", S.gray_scale("score_diff"))
    return writers.to_bed9(df).distinct()


@query("""with a as (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount from lineitem), b as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, case when l_partkey % 5 = 0 then l_discount + 0.01 else l_discount + 1e-12 end as d2 from a where l_suppkey % 11 <> 0)
    select a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey, a.l_extendedprice, case when b.d2 is null then 'left' else 'both' end as side, 'l_discount' as columns from a left join b using (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) where b.d2 is null or abs(l_discount - d2) > 1e-9""")
def table_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    a = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*keys, "l_discount").distinct()
    b = a.filter("l_suppkey % 11 <> 0").withColumn("l_discount", F.when(F.col("l_partkey") % 5 == 0, F.col("l_discount") + 0.01).otherwise(F.col("l_discount") + 1e-12))
    return compare.diff_tables(a, b, keys).withColumn("columns", F.array_join("columns", ","))
