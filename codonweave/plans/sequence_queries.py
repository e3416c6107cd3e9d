"""Codon decoding, parameter estimation, sequences and splice sites over derived inputs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonweave.functions import scalars as S
from codonweave.operators import hmm, mixture, splice
from codonweave.plans.inputs import derived, with_inputs
from codonweave.plans.registry import query

_BLOCKS = """usable as (select * from codons where bls > 0.1), marked as (select *, case when pos = lag(pos) over (partition by chrom, strand, frame order by pos) + 3 then 0 else 1 end as fresh from usable),
    numbered as (select *, sum(fresh) over (partition by chrom, strand, frame order by pos rows between unbounded preceding and current row) as k from marked),
    blocks as (select chrom, strand, frame, pos, score, min(pos) over (partition by chrom, strand, frame, k) as block from numbered)"""


@query(with_inputs("codons") + ", " + _BLOCKS + " select chrom, strand, frame, block, count(*) as codons, max(pos) as last_pos from blocks group by chrom, strand, frame, block")
def usable_codon_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = hmm.assign_blocks(hmm.usable_codons(derived(spark, sf_dir, "codons")), bucket=500)
    return blocks.groupBy("chrom", "strand", "frame", "block").agg(F.count("*").alias("codons"), F.max("pos").alias("last_pos"))


def _viterbi_sql() -> str:
    """The likeliest path of every block by a recursive query: a probability and a path for each last state."""
    m = hmm.coding_hmm(*hmm.HMM_PRESETS["human"])
    t, states = m.transitions, range(4)
    emit = "pow(10, {x}.score / 10)"
    start = ", ".join(f"{float(m.prior[j])!r}::double * {emit.format(x='b') if j == 0 else '1'} as p{j}, '{j}' as s{j}" for j in states)
    ways = {j: [k for k in states if t[k, j] > 0] for j in states}

    def best(j: int) -> tuple[str, str]:
        w = {k: f"v.p{k} * {float(t[k, j])!r}::double" for k in ways[j]}
        top = f"greatest({', '.join(w.values())})"
        path = "case " + " ".join(f"when {w[k]} = {top} then v.s{k}" for k in reversed(ways[j])) + " end"
        return f"{top} * {emit.format(x='b') if j == 0 else '1'}", f"{path} || '{j}'"

    raw = ", ".join(f"{best(j)[0]} as q{j}, {best(j)[1]} as s{j}" for j in states)
    scaled = ", ".join(f"q{j} / greatest(q0, q1, q2, q3) as p{j}, s{j}" for j in states)
    return f"""{with_inputs('codons').replace('with ', 'with recursive ', 1)}, {_BLOCKS}, v as (
        select chrom, strand, frame, block, pos, {start} from blocks b where pos = block
        union all select chrom, strand, frame, block, pos, {scaled} from (select b.chrom, b.strand, b.frame, b.block, b.pos, {raw} from v join blocks b on v.chrom = b.chrom and v.strand = b.strand and v.frame = b.frame and v.block = b.block and b.pos = v.pos + 3)),
    ends as (select * from v qualify pos = max(pos) over (partition by chrom, strand, frame, block)),
    paths as (select chrom, strand, frame, block, case when p0 >= greatest(p1, p2, p3) then s0 when p1 >= greatest(p2, p3) then s1 when p2 >= p3 then s2 else s3 end as path from ends),
    states as (select chrom, strand, frame, block, i, substr(path, i, 1) as state from (select *, unnest(range(1, length(path) + 1)) as i from paths)),
    runs as (select *, i - row_number() over (partition by chrom, strand, frame, block order by i) as run from states where state = '0')"""


def _posterior_sql(table: str, keys: list[str], step: int, prior: np.ndarray, moves: np.ndarray) -> str:
    """Scaled forward and backward numbers of rows (keys, i, n, e0, e1, ...) by recursive queries: fw and bw. i goes from 1 to n by one."""
    states = range(len(prior))
    own, same = ", ".join(keys), " and ".join(f"o.{k} = x.{k}" for k in keys)
    theirs, e = ", ".join(f"o.{k}" for k in keys), ", ".join(f"e{j}" for j in states)
    most = "greatest(" + ", ".join(f"q{j}" for j in states) + ")"
    into = ", ".join("(" + " + ".join(f"x.f{k} * {float(moves[k, j])!r}::double" for k in states if moves[k, j]) + f") * o.e{j} as q{j}" for j in states)
    back = ", ".join(" + ".join(f"{float(moves[k, j])!r}::double * x.e{j} * x.b{j}" for j in states if moves[k, j]) + f" as q{k}" for k in states)
    return f"""fw as (select {own}, i, {', '.join(f'{float(prior[j])!r}::double * e{j} as f{j}' for j in states)} from {table} where i = 1
        union all select {own}, i, {', '.join(f'q{j} / {most} as f{j}' for j in states)} from (select {theirs}, o.i, {into} from fw x join {table} o on {same} and o.i = x.i + 1)),
    bw as (select {own}, i, {e}, {', '.join(f'1::double as b{j}' for j in states)} from {table} where i = n
        union all select {own}, i, {e}, {', '.join(f'q{j} / {most} as b{j}' for j in states)} from (select {theirs}, o.i, {', '.join(f'o.e{j}' for j in states)}, {back} from bw x join {table} o on {same} and o.i = x.i - 1)),
    post as (select {own}, i, f0 * b0 / ({' + '.join(f'f{j} * b{j}' for j in states)}) as p0 from fw join bw using ({own}, i))"""


@query(_viterbi_sql() + """
    select chrom, strand, frame, block + 3 * (min(i) - 1) as start, block + 3 * max(i) - 1 as stop from runs group by chrom, strand, frame, block, run""")
def coding_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.coding_regions(derived(spark, sf_dir, "codons")).select("chrom", "strand", "frame", "start", "stop")


#: Log odds above this are given as this: 1 - p of two engines is no longer the same there.
_CLEAR = 8


def _scores_sql() -> str:
    m, block = hmm.coding_hmm(*hmm.HMM_PRESETS["human"]), ["chrom", "strand", "frame", "block"]
    rows = "lit as (select chrom, strand, frame, block, (pos - block) // 3 + 1 as i, count(*) over (partition by chrom, strand, frame, block) as n, pow(10, score / 10) as e0, 1::double as e1, 1::double as e2, 1::double as e3 from blocks)"
    return f"""{_viterbi_sql()}, {rows}, {_posterior_sql('lit', block, 1, m.prior, m.transitions)},
    best as (select chrom, strand, frame, block + 3 * (min(i) - 1) as start, block + 3 * max(i) - 1 as stop, max(p0) as p from runs join post using (chrom, strand, frame, block, i) group by chrom, strand, frame, block, run),
    odds as (select *, case when p <= 0 then -15 when p >= 1 then 15 else greatest(-15, least(15, log10(p / (1 - p)))) end as x from best)
    select chrom, strand, frame, start, stop, round(least(x, {_CLEAR}), 3) as log_odds, case when x < 1 then 210 when x > 7 then 0 else 210 - 30 * floor(x) end::bigint as gray from odds"""


@query(_scores_sql())
def coding_region_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.coding_regions(derived(spark, sf_dir, "codons")).withColumn("log_odds", F.round(F.least("log_odds", F.lit(float(_CLEAR))), 3))


#: Two states over event types in alphabetical order.
_TYPES = ("click", "error", "purchase", "signup", "view")
_PRIOR, _MOVES = np.array([0.6, 0.4]), np.array([[0.9, 0.1], [0.2, 0.8]])
_EMIT = np.array([[0.30, 0.1], [0.05, 0.4], [0.15, 0.2], [0.1, 0.2], [0.40, 0.1]])


def _discrete() -> hmm.Hmm:
    return hmm.Hmm(_PRIOR, _MOVES, hmm.MatrixEmissions(np.vstack([_EMIT, [[0.1, 0.1]]])))


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    code = F.coalesce(F.array_position(F.array(*map(F.lit, _TYPES)), F.col("event_type")) - 1, F.lit(-1))
    return events.select("user_id", "ts", "event_id", F.when(code >= 0, code).otherwise(len(_TYPES)).cast("long").alias("obs"))


@query("with recursive " + ", ".join(["obs as (select user_id, row_number() over (partition by user_id order by ts, event_id) as i, " + ", ".join("case event_type " + " ".join(f"when '{t}' then {float(_EMIT[k, j])!r}" for k, t in enumerate(_TYPES)) + f" else 0.1 end::double as e{j}" for j in (0, 1)) + " from events)", f"""f as (
    select user_id, i, {float(_PRIOR[0])!r} * e0 as f0, {float(_PRIOR[1])!r} * e1 as f1, 0::double as logs from obs where i = 1
    union all select user_id, i, a / greatest(a, b), b / greatest(a, b), logs + ln(greatest(a, b)) from (select o.user_id, o.i, (f0 * 0.9::double + f1 * 0.2::double) * e0 as a, (f0 * 0.1::double + f1 * 0.8::double) * e1 as b, logs from f join obs o on o.user_id = f.user_id and o.i = f.i + 1))"""]) + " select user_id, round(logs + ln(f0 + f1), 6) as log_likelihood from f qualify i = max(i) over (partition by user_id)")
def hmm_log_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hmm.hmm_log_likelihood(_observations(spark, sf_dir), ["user_id"], ["ts", "event_id"], "obs", _discrete(), chunk=hmm.CHUNK)
    return out.withColumn("log_likelihood", F.round("log_likelihood", 6))


_OBS = "with recursive obs as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as i, count(*) over (partition by user_id) as n, " + ", ".join("case event_type " + " ".join(f"when '{t}' then {float(_EMIT[k, j])!r}" for k, t in enumerate(_TYPES)) + f" else 0.1 end::double as e{j}" for j in (0, 1)) + " from events)"


def _path_sql() -> str:
    """The likeliest path of each user: a probability and a path for each last state; of equal predecessors the last, of equal ends the first."""
    ways = {j: [f"x.p{k} * {float(_MOVES[k, j])!r}::double" for k in (0, 1)] for j in (0, 1)}
    next_ = ", ".join(f"greatest({ways[j][0]}, {ways[j][1]}) * o.e{j} as q{j}, case when {ways[j][1]} >= {ways[j][0]} then x.s1 else x.s0 end || '{j}' as s{j}" for j in (0, 1))
    return f"""{_OBS}, v as (select user_id, i, {float(_PRIOR[0])!r}::double * e0 as p0, '0' as s0, {float(_PRIOR[1])!r}::double * e1 as p1, '1' as s1 from obs where i = 1
        union all select user_id, i, q0 / greatest(q0, q1), s0, q1 / greatest(q0, q1), s1 from (select o.user_id, o.i, {next_} from v x join obs o on o.user_id = x.user_id and o.i = x.i + 1)),
    ends as (select user_id, case when p0 >= p1 then s0 else s1 end as path from v qualify i = max(i) over (partition by user_id))
    select user_id, event_id, substr(path, i, 1)::bigint as state from obs join ends using (user_id)"""


@query(_path_sql())
def hmm_best_path_discrete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.hmm_decode(_observations(spark, sf_dir), ["user_id"], ["ts", "event_id"], "obs", _discrete(), chunk=hmm.CHUNK).select("user_id", "event_id", "state")


@query(f"{_OBS}, {_posterior_sql('obs', ['user_id'], 1, _PRIOR, _MOVES)} select user_id, event_id, round(p0, 6) as p0 from post join obs using (user_id, i)")
def hmm_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hmm.hmm_decode(_observations(spark, sf_dir), ["user_id"], ["ts", "event_id"], "obs", _discrete(), posteriors=True, chunk=hmm.CHUNK)
    return out.select("user_id", "event_id", F.round(F.col("posterior")[0], 6).alias("p0"))


def _framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "regions").select("chrom", "strand", S.frame("start").alias("frame"), "start", "stop")


_PRUNED = with_inputs("regions").replace("with ", "with recursive ", 1) + """, e as (select chrom, strand, start % 3 as frame, start, stop, row_number() over (partition by chrom, strand, start % 3 order by start, stop) as i from regions),
    g as (select chrom, strand, frame, i, start as s, stop as z, null::bigint as out_s, null::bigint as out_z from e where i = 1
        union all select e.chrom, e.strand, e.frame, e.i, case when e.start > g.z or e.stop - e.start > g.z - g.s then e.start else g.s end, case when e.start > g.z or e.stop - e.start > g.z - g.s then e.stop else g.z end,
            case when e.start > g.z then g.s end, case when e.start > g.z then g.z end from g join e on e.chrom = g.chrom and e.strand = g.strand and e.frame = g.frame and e.i = g.i + 1),
    pruned as (select chrom, strand, frame, out_s as start, out_z as stop from g where out_s is not null union all select chrom, strand, frame, s, z from (select * from g qualify i = max(i) over (partition by chrom, strand, frame)))"""


@query(_PRUNED + " select * from pruned")
def prune_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.prune_overlaps(_framed(spark, sf_dir))


@query(_PRUNED + " select * from (select chrom, strand, frame, lead(start) over (partition by chrom, strand, frame order by start) - stop - 1 as gap from pruned) where gap > 0")
def exon_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.exon_gaps(mixture.prune_overlaps(_framed(spark, sf_dir)))


@query(_PRUNED + " select count(*) as exons, sum(stop - start + 1)::bigint as bases, round(sum(stop - start + 1) / 100000000 / 6, 9) as prior, round(sum(stop - start + 1) / count(*) / 3, 6) as codons from pruned")
def coding_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixture.coding_stats(mixture.prune_overlaps(_framed(spark, sf_dir)), 100_000_000)
    return out.withColumns({"prior": F.round("prior", 9), "codons": F.round("codons", 6)})


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = F.lead(us).over(W.partitionBy("user_id").orderBy("ts", "event_id")) - us
    return events.select("event_id", F.floor(gap / 1_000_000).alias("gap")).filter("gap > 0")


_STEPS = 5
_GAPS = "gaps as (select event_id, floor(g / 1000000)::bigint as gap from (select event_id, lead(epoch_us(ts)) over (partition by user_id order by ts, event_id) - epoch_us(ts) as g from events) where floor(g / 1000000) > 0), h as (select gap::double as x, count(*) as n from gaps group by gap)"


def _em_sql(steps: int = _STEPS, gaps: str = _GAPS) -> str:
    total = sum(mixture.WEIGHTS)
    parts = [gaps, "m0 as (select " + ", ".join(f"{g!r}::double as t{j}, {w / total!r}::double as w{j}" for j, (g, w) in enumerate(zip(mixture.GUESSES, mixture.WEIGHTS))) + ")"]
    for k in range(steps):
        d = [f"w{j} * exp(-x / t{j} - ln(t{j}))" for j in range(3)]
        all_d = " + ".join(d)
        r = ", ".join(f"case when {all_d} > 0 then {x} / ({all_d}) else 1.0 / 3 end as r{j}" for j, x in enumerate(d))
        parts.append(f"m{k + 1} as (select " + ", ".join(f"sum(n * r{j} * x) / sum(n * r{j}) as t{j}, sum(n * r{j}) / sum(n) as w{j}" for j in range(3)) + f" from (select x, n, {r} from h, m{k}))")
    return "with " + ", ".join(parts)


@query(_em_sql() + f" select j, round(t, 4) as mean, round(w, 6) as weight from (select unnest([0, 1, 2]) as j, unnest([t0, t1, t2]) as t, unnest([w0, w1, w2]) as w from m{_STEPS})")
def gap_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    means, weights = mixture.fit_exponential_mixture(_gaps(spark, sf_dir), "gap", 3, _STEPS)
    rows = [(j, round(m, 4), round(w, 6)) for j, (m, w) in enumerate(zip(means, weights))]
    return spark.createDataFrame(rows, "j int, mean double, weight double")


@query(_em_sql() + f", d as (select event_id, " + ", ".join(f"w{j} * exp(-gap / t{j} - ln(t{j})) as d{j}" for j in range(3)) + f" from gaps, m{_STEPS}) select event_id, " + ", ".join(f"round(d{j} / (d0 + d1 + d2), 5) as p{j}" for j in range(3)) + " from d")
def mixture_class_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = _gaps(spark, sf_dir)
    means, weights = mixture.fit_exponential_mixture(gaps, "gap", 3, _STEPS)
    out = mixture.class_probabilities(gaps, "gap", [mixture.Exponential()] * 3, [(m,) for m in means], weights)
    return out.select("event_id", *[F.round(F.col("class_probs")[j], 5).alias(f"p{j}") for j in range(3)])


def _parameters_sql() -> str:
    pruned = _PRUNED.removeprefix("with recursive ").replace("pruned as (", "pruned as materialized (")
    gaps = pruned + """, gaps as (select gap from (select lead(start) over (partition by chrom, strand, frame order by start) - stop - 1 as gap from pruned) where gap > 0),
    h as materialized (select gap::double as x, count(*) as n from gaps group by gap)"""
    fitted = ", ".join([f"round(w{j}, 6) as weight{j}" for j in range(3)] + [f"round(t{j} / 3, 4) as length{j}" for j in range(3)])
    stats = "select sum(stop - start + 1) / 100000000 / 6 as prior, sum(stop - start + 1) / count(*) / 3 as codons from pruned"
    return _em_sql(20, gaps).replace("with ", "with recursive ", 1) + f" select round(prior, 9) as prior, round(codons, 6) as coding_length, {fitted} from m20, ({stats})"


@query(_parameters_sql())
def hmm_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior, length, weights, lengths = mixture.estimate_hmm_params(_framed(spark, sf_dir), 100_000_000)
    names = ["prior", "coding_length", *[f"weight{j}" for j in range(3)], *[f"length{j}" for j in range(3)]]
    digits = [9, 6, *[6] * 3, *[4] * 3]
    return spark.createDataFrame([(prior, length, *weights, *lengths)], ", ".join(f"{n} double" for n in names)).select(*[F.round(n, d).alias(n) for n, d in zip(names, digits)])


_DNA = with_inputs("dna")


@query(_DNA + " select doc_id, reverse(translate(seq, 'ACGT', 'TGCA')) as rc, case when doc_id % 2 = 0 then reverse(translate(seq, 'ACGT', 'TGCA')) else seq end as mapped from dna")
def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    strand = F.when(F.col("doc_id") % 2 == 0, "-").otherwise("+")
    return derived(spark, sf_dir, "dna").select("doc_id", S.reverse_complement("seq").alias("rc"), S.map_to_strand("seq", strand).alias("mapped"))


#: Windows that are cut from one stretch of a sequence.
_STRETCH = 512


def _windows(spark: SparkSession, sf_dir: str, k: int, name: str) -> DataFrame:
    """doc_id, pos (1-based) and bases of every window of k bases. Sequences are cut into stretches first, as substring counts from the start."""
    dna = derived(spark, sf_dir, "dna").filter(F.length("seq") >= k)
    starts = F.explode(F.sequence(F.lit(1), F.length("seq") - k + 1, F.lit(_STRETCH))).alias("first")
    parts = dna.select("doc_id", "seq", starts).select("doc_id", "first", F.substring("seq", F.col("first"), F.lit(_STRETCH + k - 1)).alias("part"))
    at = F.explode(F.sequence(F.lit(1), F.length("part") - k + 1)).alias("i")
    return parts.select("doc_id", "first", "part", at).select("doc_id", (F.col("first") + F.col("i") - 1).cast("long").alias("pos"), F.substring("part", F.col("i"), F.lit(k)).alias(name))


def _windows_sql(k: int, name: str) -> str:
    return f"{_DNA}, w as (select doc_id, pos, substr(seq, pos, {k}) as {name} from (select doc_id, seq, unnest(range(1, length(seq) - {k} + 2)) as pos from dna where length(seq) >= {k}))"


_KMER_SQL = _windows_sql(7, "kmer") + " select doc_id, pos, kmer, (" + " + ".join(f"(instr('ACGT', substr(kmer, {i + 1}, 1)) - 1) * {4 ** (6 - i)}" for i in range(7)) + ")::bigint as idx from w"


@query(_KMER_SQL)
def kmer_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, 7, "kmer").withColumn("idx", S.kmer_index("kmer"))


@query(_KMER_SQL)
def kmer_index_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kmer_index by its former name."""
    return kmer_index(spark, sf_dir)


@query(with_inputs("regions") + " select rid, chrom || ':' || start || '-' || stop as region, chrom || ':' || start || '-' || stop || ':' || strand as name, chrom || ':' || start || '-' || (start + 2) || '+' || chrom || ':' || (stop - 2) || '-' || stop as parts from regions")
def region_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = F.array(F.struct(F.col("start"), (F.col("start") + 2).alias("stop")), F.struct((F.col("stop") - 2).alias("start"), F.col("stop")))
    return derived(spark, sf_dir, "regions").select("rid", S.region_string("chrom", "start", "stop").alias("region"), S.region_name("chrom", "start", "stop", "strand").alias("name"), S.regions_string("chrom", two).alias("parts"))


@query(with_inputs("regions") + " select rid, chrom, unnest([start, -stop]) as start, unnest([stop, -start]) as stop from regions")
def parse_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws("", "chrom", F.lit(":"), F.format_number("start", 0), F.lit("-"), F.format_number("stop", 0), F.lit("+"), "chrom", F.lit(":-"), F.col("stop").cast("string"), F.lit("--"), F.col("start").cast("string"))
    return derived(spark, sf_dir, "regions").select("rid", F.inline(S.parse_regions(text)))


@query(with_inputs("regions") + " select rid, start + d as a_start, stop + d as a_stop, case when strand = '+' then '-' else '+' end as a_strand from (select *, case when strand = '+' then 2 else -2 end as d from regions)")
def anti_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = S.anti_interval("start", "stop", "strand")
    return derived(spark, sf_dir, "regions").select("rid", x["start"].alias("a_start"), x["stop"].alias("a_stop"), x["strand"].alias("a_strand"))


@query(with_inputs("features") + " select rid, round(case when p <= 0 then -15 when p >= 1 then 15 else greatest(-15, least(15, log10(p / (1 - p)))) end, 6) as log_odds, round(pow(10, score_diff / 10), 6) as ratio from (select *, score_diff as p from features)")
def log_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "features").select("rid", F.round(S.prob_to_log_odds("score_diff"), 6).alias("log_odds"), F.round(S.decibans_to_ratio("score_diff"), 6).alias("ratio"))


@query("select p_partkey, regexp_matches(p_brand, '^[0-9]+$') as brand_int, regexp_matches(p_size::varchar, '^[0-9]+$') as size_int, true as price_number, regexp_replace(p_brand, '[0-9]+$', '') as bare, case when p_type like '%Y' then left(p_type, length(p_type) - 1) else p_type end as cut, string_split(p_name, ' ')[1] as word from part")
def string_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(
        "p_partkey", S.is_int_string("p_brand").alias("brand_int"), S.is_int_string(F.col("p_size").cast("string")).alias("size_int"), S.is_number_string(F.col("p_retailprice").cast("string")).alias("price_number"),
        S.without_trailing_digits("p_brand").alias("bare"), S.without_trailing_char("p_type", "Y").alias("cut"), S.split_or_empty("p_name", " ")[0].alias("word"),
    )


def _coefficients(spark: SparkSession, sizes: list[int]) -> DataFrame:
    """Coefficients by rule: ((i * 7919 + 13) % 99991 + 1) / 99991 for the i-th of all."""
    out, before = None, 0
    for k, n in enumerate(sizes):
        i = F.col("id") + before
        part = spark.range(n).select(F.lit(k).alias("arr"), F.col("id").alias("idx"), (((i * 7919 + 13) % 99991 + 1) / F.lit(99991.0)).alias("coef"))
        out, before = part if out is None else out.unionByName(part), before + n
    return out


def _index_sql(text: str, a: int, n: int) -> str:
    return "(" + " + ".join(f"(instr('ACGT', substr({text}, {a + i + 1}, 1)) - 1) * {4 ** (n - 1 - i)}" for i in range(n)) + ")"


def _coef_sql(i: str) -> str:
    return f"((({i} * 7919 + 13) % 99991 + 1) / 99991.0::double)"


_DONOR_SQL = f"log2({splice.DONOR_FACTOR!r}::double * {_coef_sql(_index_sql('context', 0, 7))})"
_WINDOWS = [*splice.TIMES, *splice.DIVIDE]
_ARRAYS = [_coef_sql(f"({_index_sql('context', a, b - a + 1)} + {sum(splice.SIZES[:k])})") for k, (a, b) in enumerate(_WINDOWS)]
_ACCEPTOR_SQL = f"log2({splice.ACCEPTOR_FACTOR!r}::double * {' * '.join(_ARRAYS[:5])} / ({' * '.join(_ARRAYS[5:])}))"


_DONORS = _windows_sql(7, "context") + f" select doc_id, pos, context, round({_DONOR_SQL}, 6) as donor_score from w"
_ACCEPTORS = _windows_sql(21, "context") + f" select doc_id, pos, context, round({_ACCEPTOR_SQL}, 6) as acceptor_score from w"


@query(_DONORS)
def donor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splice.donor_score(_windows(spark, sf_dir, 7, "context"), "context", _coefficients(spark, [4**7])).withColumn("donor_score", F.round("donor_score", 6))


@query(_ACCEPTORS)
def acceptor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splice.acceptor_score(_windows(spark, sf_dir, 21, "context"), "context", _coefficients(spark, splice.SIZES)).withColumn("acceptor_score", F.round("acceptor_score", 6))


@query(_DONORS)
def donor_window_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """donor_scores by its former name."""
    return donor_scores(spark, sf_dir)


@query(_ACCEPTORS)
def acceptor_window_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """acceptor_scores by its former name."""
    return acceptor_scores(spark, sf_dir)


@query(_DNA + f""", s as (select doc_id as name, '+' as strand, seq, length(seq) as n from dna union all select doc_id, '-', reverse(translate(seq, 'ACGT', 'TGCA')), length(seq) from dna),
    p as (select *, unnest(range(1, n)) as i from s), d as (select name, strand, 'donor' as kind, case when strand = '+' then i else n - i + 1 end as pos, substr(seq, i - 3, 3) || substr(seq, i + 2, 4) as context from p where substr(seq, i, 2) = 'GT' and i > 3 and i + 5 <= n),
    a as (select name, strand, 'acceptor' as kind, case when strand = '+' then i else n - i + 1 end as pos, substr(seq, i - 18, 18) || substr(seq, i + 2, 3) as context from p where substr(seq, i, 2) = 'AG' and i > 18 and i + 4 <= n)
    select name, strand, kind, pos, context, round({_DONOR_SQL}, 6) as score from d union all select name, strand, kind, pos, context, round({_ACCEPTOR_SQL}, 6) from a""")
def splice_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    dna = derived(spark, sf_dir, "dna").select(F.col("doc_id").alias("name"), F.lit(0).cast("long").alias("offset"), "seq")
    dna = splice.overlapping(dna, 1000)  # so that sites at the edges of chunks are among them
    return splice.scan_splice_sites(dna, _coefficients(spark, [4**7]), _coefficients(spark, splice.SIZES)).withColumn("score", F.round("score", 6))
