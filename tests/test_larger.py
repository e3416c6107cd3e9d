"""What shows only on larger tables: keys beyond those of the driver's smallest tables, rows that repeat, jobs in rounds, and what they leave on disk."""

from __future__ import annotations

import glob
import random

import duckdb
import pandas as pd
import pytest

from pyspark.sql import functions as F

from codonweave.operators import intervals, regions, rounds, scoring
from codonweave.plans import catalog, region_queries
from codonweave.plans.inputs import derived
from codonweave.session import stored
from test_catalog import normal


@pytest.fixture
def same_as_sql(spark, tmp_path):
    """Compares a query with its SQL on the given tables."""

    def check(name: str, **tables: pd.DataFrame) -> None:
        con = duckdb.connect()
        for t, df in tables.items():
            df.to_parquet(f"{tmp_path}/{t}.parquet", index=False)
            con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
        got = normal(catalog.queries()[name](spark, str(tmp_path)).toPandas())
        pd.testing.assert_frame_equal(got, normal(con.sql(catalog.oracle_sql()[name]).df()))
        assert len(got)

    return check


def test_complement_beyond_the_last_bound(sf_dir, same_as_sql):
    """Regions on both sides of 100,000,000, as keys of larger tables give them."""
    items = pd.read_parquet(f"{sf_dir}/lineitem.parquet")
    items["l_orderkey"] += 100_000_000 // 30 - items["l_orderkey"].max() // 2
    same_as_sql("complement_region", lineitem=items)


def test_boxes_of_one_shape_are_compared_once(spark, monkeypatch):
    """Many boxes of few shapes, in lists: as many comparisons as lists, and the pairs that a loop gives."""
    monkeypatch.setattr(intervals, "ALIKE", 16)
    shapes = [(0.0, 2.0, 0.0, 2.0), (1.0, 1.0, 1.0, 5.0), (3.0, 9.0, -1.0, 4.0), (5.0, 4.0, 0.0, 9.0), (0.0, None, 0.0, 9.0)]
    boxes = [(i, *shapes[i % 5], "odd" if i % 2 else None) for i in range(400)]
    points = [(k, float(k % 7), float(k % 5)) for k in range(60)] + [(60, None, 1.0)]
    p = spark.createDataFrame(points, "k int, x double, y double")
    b = spark.createDataFrame(boxes, "j int, xmin double, xmax double, ymin double, ymax double, note string")
    assert intervals._shapes(b.filter("xmin <= xmax")).count() <= 3 * -(-80 // 16)
    found = intervals.points_in_boxes(p, b, share=8)
    assert found.columns == ["k", "x", "y", *b.columns]
    want = [(*q, *r) for q in points for r in boxes if q[1] is not None and r[2] is not None and r[1] <= q[1] <= r[2] and r[3] <= q[2] <= r[4]]
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(want, key=str) and want


def left(spark) -> set[str]:
    return set(glob.glob(spark.conf.get("spark.checkpoint.dir") + "/*"))


@pytest.mark.parametrize("name", ["overlapping_transcripts", "classify", "extension_regions", "classify_regions", "score_fields", "unscored_regions"])
def test_regions_in_rounds(spark, sf_dir, monkeypatch, name):
    """Three rounds or more give the rows of the SQL; what they wrote on their way is gone, and so are their shuffle files."""
    rounds_made, put = [], rounds.stored_in_turn
    monkeypatch.setattr(rounds, "ROUND", 2500)
    monkeypatch.setattr(rounds, "stored_in_turn", lambda makes: rounds_made.append(len(makes)) or put(makes))
    before = left(spark)
    found = catalog.queries()[name](spark, sf_dir)
    assert rounds_made and min(rounds_made) >= 3
    assert len(left(spark) - before) <= 3  # two inputs and the result
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{sf_dir}/lineitem.parquet'")
    pd.testing.assert_frame_equal(normal(found.toPandas()), normal(con.sql(catalog.oracle_sql()[name]).df()))


def test_rows_without_place_in_rounds(spark, monkeypatch):
    """Nulls, empty intervals, equal places and segments that hold others: as a loop has them, in rounds and in one go, of unique names and others."""
    rng = random.Random(5)
    spans = [(f"r{k}", rng.choice(["a", "b", "é", None]), a, a + rng.choice([0, 3, 60, 900, -1])) for k in range(120) for a in [rng.choice([0, 500, 4000, 9000]) + rng.randrange(40)]]
    spans += [("n1", "a", None, 5), ("n2", "a", 5, None), ("n3", "b", -(1 << 61), 1 << 61)]
    parts = [(rng.choice([*range(12), None]), rng.choice(["a", "b", "é", None]), rng.choice("+-"), a, a + rng.choice([0, 9, 80, 5000, -2])) for _ in range(150) for a in [rng.randrange(-50, 9800)]]
    regs = spark.createDataFrame(spans, "name string, chrom string, start long, stop long")
    segs = spark.createDataFrame(parts, "tr_id int, chrom string, strand string, start long, stop long")
    want = sorted({(n, t) for n, c, a, z in spans for t, d, _, b, y in parts if None not in (a, z, c, d) and c == d and a <= z and b <= y and a <= y and b <= z}, key=str)
    for most in (20, rounds.ROUND):
        monkeypatch.setattr(rounds, "ROUND", most)
        for unique in (True, False):
            assert sorted((tuple(r) for r in intervals.overlapping_transcripts(regs, segs, "name", unique=unique).collect()), key=str) == want
    monkeypatch.setattr(rounds, "ROUND", 20)
    table = stored(regs)
    assert sorted(map(str, rounds.by_place(table, [], lambda own: own).collect())) == sorted(map(str, regs.collect()))


def test_scores_of_any_strand_in_rounds(spark, monkeypatch):
    """Own and antisense scores of regions on '+', '-', '.' and no strand, missing and failed ones: as a loop has them."""
    rng = random.Random(8)
    place = lambda: (rng.choice(["a", None] + ["b"] * 6), rng.randrange(0, 30), rng.choice(["+", "-", ".", None]))
    regs = [(f"r{k}", c, s, a, a + 5) for k in range(300) for c, a, s in [place()]] + [("n", "b", "+", None, 5)]
    known = {(c, a, a + 5, s): (rng.choice(["ok", "ok", "failure", None]), rng.choice([1.5, 3.0, None]), rng.choice([0.5, None])) for c, a, s in (place() for _ in range(150))}
    keys = "chrom string, start long, stop long, strand string"
    a = spark.createDataFrame(regs, "rid string, chrom string, strand string, start long, stop long")
    b = spark.createDataFrame([(*k, *v) for k, v in known.items()], f"{keys}, status string, raw double, bls double")
    met = {k: v for k, v in known.items() if None not in k}
    want = []
    for r, c, s, x, z in regs:
        by = 0 if x is None else 2 if s == "+" else -2
        own = met.get((c, x, z, s), (None, None, None))
        anti = met.get((c, x + by, z + by, {"+": "-", "-": "+"}.get(s, s)), (None, None, None)) if x is not None else (None, None, None)
        raw, other = own[1], anti[1] if anti[0] not in (None, "failure") else None
        want.append((r, own[2], raw and raw / 2, other and other / 2, raw and raw / 2 - (other or 0) / 2))
    for most in (40, rounds.ROUND):
        monkeypatch.setattr(rounds, "ROUND", most)
        got = scoring.add_score_fields(a, b).select("rid", "bls", "score_per_codon", "anti_score_per_codon", "score_diff")
        assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert len({w[2:4] for w in want}) > 6


def test_candidates_in_rounds(spark, sf_dir, monkeypatch):
    """The candidates that the operators find in one go; only the scored rows and the ranked ones are left."""
    larger = sf_dir.replace("sf0.001", "sf0.01")
    table = regions.classify_regions(*region_queries._kinds(spark, larger))
    keys = ["chrom", "start", "stop", "strand"]
    scores = derived(spark, larger, "scores").groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("status", "raw", "bls")])
    want = {tuple(r) for r in scoring.candidate_regions(table, scores, 200).select("rid", "name", *keys).collect()}
    monkeypatch.setattr(rounds, "ROUND", 25_000)
    before = left(spark)
    found = catalog.queries()["candidate_regions"](spark, larger)
    assert len(left(spark) - before) == 2
    rows = found.select("rid", "name", *keys, "rank").collect()
    assert {tuple(r)[:-1] for r in rows} == want and sorted(r["rank"] for r in rows) == list(range(1, len(want) + 1))
