"""Inputs of coding-region jobs derived from the driver tables.

Each is one SQL projection that Spark and other engines read alike, so that results can be compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonweave.operators.rounds import by_key
from codonweave.session import once

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

_CHROM = "'chr' || cast(l_suppkey % 3 as string)"
_STRAND = "case when l_linestatus = 'O' then '+' else '-' end"
_RID = "cast(l_orderkey as string) || ':' || cast(l_linenumber as string) || ':' || cast(l_partkey as string) || ':' || cast(l_suppkey as string) || ':' || cast(cast(round(l_extendedprice * 100) as bigint) as string)"
_START = "cast(3 * (10 * l_orderkey + l_partkey % 50) + l_linenumber % 3 + 1 as bigint)"

SQL = {
    "codons": f"""select {_CHROM} as chrom, {_STRAND} as strand, cast(l_linenumber % 3 as bigint) as frame, cast(3 * l_partkey + l_linenumber % 3 as bigint) as pos,
        min((l_discount - 0.03) * 1000) as score, min(l_tax * 5) as bls from lineitem group by 1, 2, 3, 4""",
    "regions": f"""select rid, min(chrom) as chrom, min(strand) as strand, min(start) as start, min(stop) as stop from (
        select {_RID} as rid, {_CHROM} as chrom, {_STRAND} as strand, {_START} as start, {_START} + 3 * cast(l_quantity as bigint) - 1 as stop from lineitem) r group by rid""",
    "exons": """select tr_id, 'chr' || cast(tr_id % 3 as string) as chrom, case when tr_id % 2 = 0 then '+' else '-' end as strand, idx,
            30 * tr_id + 1 + before as start, 30 * tr_id + before + size as stop, cum, len,
            cast(floor(len / 10) as bigint) + 1 as cs, cast(floor(len / 10) as bigint) + 3 * cast(floor(cast(floor(8 * len / 10) as bigint) / 3) as bigint) as ce
        from (select l_orderkey as tr_id, size, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as bigint) as idx,
                cast(coalesce(sum(size + gap) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows between unbounded preceding and 1 preceding), 0) as bigint) as before,
                cast(coalesce(sum(size) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows between unbounded preceding and 1 preceding), 0) as bigint) as cum,
                cast(sum(size) over (partition by l_orderkey) as bigint) as len
            from (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, 10 + cast(l_quantity as bigint) as size, 20 + l_partkey % 50 as gap from lineitem) x) y""",
    "dna": "select doc_id, regexp_replace(upper(text), '[^ACGT]', '') as seq from documents where text is not null",
    "features": f"""select {_RID} as rid, {_CHROM} as chrom, {_STRAND} as strand, {_START} as start, {_START} + 3 * cast(l_quantity as bigint) - 1 as stop,
        cast(l_quantity as bigint) as num_codons, l_extendedprice / l_quantity / 100 as score_per_codon, l_tax as bls, l_discount * 10 as score_diff,
        case l_returnflag when 'A' then 'CodingOverlap' when 'N' then 'AntisenseOverlap' else 'NoOverlap' end as reg_type from lineitem""",
    "scores": f"""select distinct chrom, start, stop, strand, status, raw, bls from (
        select {_CHROM} as chrom, {_START} + case when l_returnflag = 'R' then case when l_linestatus = 'O' then 2 else -2 end else 0 end as start,
            {_START} + 3 * cast(l_quantity as bigint) - 1 + case when l_returnflag = 'R' then case when l_linestatus = 'O' then 2 else -2 end else 0 end as stop,
            case when l_returnflag = 'R' then case when l_linestatus = 'O' then '-' else '+' end else {_STRAND} end as strand,
            case when l_linenumber = 7 then 'No_Alignment' else 'score(decibans)' end as status,
            max(l_extendedprice) over (partition by l_suppkey % 3, l_orderkey, l_partkey % 50, l_linenumber, l_quantity, l_linestatus, l_returnflag) as raw,
            max(l_tax) over (partition by l_suppkey % 3, l_orderkey, l_partkey % 50, l_linenumber, l_quantity, l_linestatus, l_returnflag) as bls from lineitem) s""",
    "points": "select p_partkey, cast(p_size as double) as x, p_retailprice as y from part",
    "boxes": "select s_suppkey, cast(s_suppkey % 40 as double) as xmin, cast(s_suppkey % 40 + 3 as double) as xmax, 900 + cast(s_suppkey % 17 as double) * 5 as ymin, 930 + cast(s_suppkey % 17 as double) * 6 as ymax from supplier",
}
#: The same where two engines need other words.
DUCKDB = {"dna": "select doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') as seq from documents where text is not null"}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = [t for t in TABLES if f"from {t}" in SQL[name]]
    return on_tables(spark, SQL[name], {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def derived_by(spark: SparkSession, sf_dir: str, name: str, table: str, key: str) -> DataFrame:
    """derived() of the one table that it is made of, written in rounds by a key of which all its windows and groups are parts; a `distinct` holds within a round."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return once(by_key([rows], [[F.col(key)]], lambda part: on_tables(spark, SQL[name], {table: part})))


def on_tables(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """SQL in which the names after `from` stand for these tables; the session's own views stay as they are."""
    for t in tables:
        sql = sql.replace(f"from {t}", f"from {{{t}}}")
    return spark.sql(sql, **tables)


def with_inputs(*names: str) -> str:
    """'with a as (...), b as (...)' for SQL on the driver tables."""
    return "with " + ", ".join(f"{n} as ({DUCKDB.get(n, SQL[n])})" for n in names)
