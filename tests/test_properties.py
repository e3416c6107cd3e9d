"""Interval algebra against sets of bases, pruning against a loop, mixtures and scorers against drawn data."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from codonweave.functions import scalars
from codonweave.operators import compare, hmm, intervals, mixture, scoring


def _draw(rng, n):
    return [(int(k), int(s), int(s + d)) for k, s, d in zip(rng.integers(0, 3, n), rng.integers(-40, 120, n), rng.integers(0, 12, n))]


def _bases(rows):
    return {(k, x) for k, a, b in rows for x in range(a, b + 1)}


def test_algebra(spark):
    rng = np.random.default_rng(5)
    for _ in range(2):
        a, b = _draw(rng, 60), _draw(rng, 60)
        da = spark.createDataFrame([(i, *x) for i, x in enumerate(a)], "row long, k long, start long, stop long")
        db = spark.createDataFrame(b, "k long, start long, stop long")
        ua, ub = (intervals.union_regions(x, ["k"], width=8) for x in (da, db))
        got = [tuple(r) for r in ua.collect()]
        assert _bases(got) == _bases(a)
        assert all(x[2] + 1 < y[1] for x, y in zip(sorted(got), sorted(got)[1:]) if x[0] == y[0])
        assert _bases([tuple(r) for r in intervals.intersect_regions(ua, ub, ["k"]).collect()]) == _bases(a) & _bases(b)
        left = intervals.subtract_regions(da, db, ["k"], "row").collect()
        assert _bases([(r["k"], r["start"], r["stop"]) for r in left]) == _bases(a) - _bases(b)
        rest = [tuple(r) for r in intervals.complement_region(da, ["k"], -50, 150).collect()]
        assert _bases(rest) == {(k, x) for k in {r[0] for r in a} for x in range(-50, 151)} - _bases(a)
        semi = intervals.overlap_join(da, db, ["k"], width=8, how="left_semi")
        want = {i for i, x in enumerate(a) if _bases([x]) & _bases(b)}
        assert {r["row"] for r in semi.collect()} == want
        assert {r["row"] for r in intervals.overlap_join(da, db, ["k"], width=8, how="left_anti").collect()} == set(range(60)) - want


def test_existence_keeps_nulls_and_repeats(spark):
    a = [("c", 1, 5, None), ("c", 1, 5, None), ("c", 3, 9, "x"), ("c", 20, 22, None), ("c", 20, 22, None), ("d", 1, 5, "y"), ("c", None, 7, "z"), (None, 1, 5, "w")]
    da = spark.createDataFrame(a, "k string, start long, stop long, note string")
    db = spark.createDataFrame([("c", 4, 6), ("c", 5, 5), (None, 1, 9)], "k string, start long, stop long")
    semi = [tuple(r) for r in intervals.overlap_join(da, db, ["k"], width=4, how="left_semi").collect()]
    anti = [tuple(r) for r in intervals.overlap_join(da, db, ["k"], width=4, how="left_anti").collect()]
    assert sorted(semi, key=repr) == sorted(a[:3], key=repr) and sorted(anti, key=repr) == sorted(a[3:], key=repr)


def test_complement_of_keys_without_intervals(spark):
    df = spark.createDataFrame([("a", 5, 9), ("a", 30, 70), ("b", 1, 100)], "k string, start long, stop long")
    sizes = spark.createDataFrame([("a", 40), ("b", 100), ("c", 17), ("d", 0)], "k string, size long")
    got = intervals.complement_region(df, ["k"], 1, F.col("size"), among=sizes, width=8).collect()
    assert sorted(map(tuple, got)) == [("a", 1, 4), ("a", 10, 29), ("c", 1, 17)]
    assert intervals.complement_region(df, ["k"], 1, 100, width=8).filter("k = 'c'").isEmpty()


def test_prefix_errors(spark):
    df = spark.createDataFrame([("t", "+", 1, 5)], "t string, strand string, start long, stop long")
    with pytest.raises(ValueError):
        intervals.intervals_prefix(df, ["t"], -1)
    assert intervals.intervals_prefix(df, ["t"], 0).count() == 0


def test_prune_against_loop(spark):
    rng = np.random.default_rng(6)
    rows = sorted({(int(s), int(s + d)) for s, d in zip(rng.integers(0, 300, 80), rng.integers(1, 30, 80))})
    kept = []
    for s, e in rows:
        if kept and s <= kept[-1][1]:
            if e - s > kept[-1][1] - kept[-1][0]:
                kept[-1] = (s, e)
        else:
            kept.append((s, e))
    df = spark.createDataFrame([("c", "+", 0, *r) for r in rows], "chrom string, strand string, frame int, start long, stop long")
    assert sorted((r["start"], r["stop"]) for r in mixture.prune_overlaps(df).collect()) == kept


def test_prune_over_batches(spark):
    rng = np.random.default_rng(16)
    rows = sorted((k, int(a), int(a + d)) for k in range(3) for a, d in zip(rng.integers(0, 90, 40), rng.integers(0, 9, 40)))
    rows += rows[:5]
    want = []
    for k, a, z in sorted(rows):
        if want and want[-1][0] == k and a <= want[-1][2]:
            if z - a > want[-1][2] - want[-1][1]:
                want[-1] = (k, a, z)
        else:
            want.append((k, a, z))
    df = spark.createDataFrame([(str(k), "+", 0, a, z) for k, a, z in rows], "chrom string, strand string, frame int, start long, stop long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    got = sorted((int(r["chrom"]), r["start"], r["stop"]) for r in mixture.prune_overlaps(df).collect())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want
    assert mixture.prune_overlaps(df.limit(0)).count() == 0


def test_prune_chains_over_many_bins(spark):
    """Chains over many narrow bins, in which what one bin hands on decides the next; no Python in the plan."""
    rng = np.random.default_rng(26)
    rows = sorted({(k, int(a), int(a + d)) for k in range(2) for a, d in zip(rng.integers(0, 400, 300), rng.integers(0, 14, 300))} | {(0, a, a + 9) for a in range(500, 900, 7)} | {(0, 1000, 5000), (0, 1003, 1010), (0, 5000, 9100), (0, 1 << 40, (1 << 40) + 5)})
    want = []
    for k, a, z in rows:
        if want and want[-1][0] == k and a <= want[-1][2]:
            if z - a > want[-1][2] - want[-1][1]:
                want[-1] = (k, a, z)
        else:
            want.append((k, a, z))
    df = spark.createDataFrame([(str(k), "+", 0, a, z) for k, a, z in rows], "chrom string, strand string, frame int, start long, stop long")
    for width in (8, 1 << 16):
        pruned = mixture.prune_overlaps(df, width=width)
        assert sorted((int(r["chrom"]), r["start"], r["stop"]) for r in pruned.collect()) == want
    assert not re.search("InArrow|InPandas|Python", pruned._jdf.queryExecution().toString())
    gaps = sorted(r["gap"] for r in mixture.exon_gaps(pruned).collect())
    assert gaps == sorted(y[1] - x[2] - 1 for x, y in zip(want, want[1:]) if x[0] == y[0] and y[1] - x[2] > 1)


def test_parameters_of_a_preset_are_recovered(spark):
    """Exons drawn from the human preset give its parameters back, after enough steps for the shortest gaps, within the tolerance of 8,000 gaps."""
    prior, length, weights, lengths = hmm.HMM_PRESETS["human"]
    rng = np.random.default_rng(17)
    kind = rng.choice(3, 8000, p=weights)
    gaps = np.maximum(1, np.round(rng.exponential(3 * np.array(lengths)[kind]))).astype(int)
    sizes = 3 * np.maximum(1, np.round(rng.exponential(length, 8000))).astype(int)
    starts = np.cumsum(gaps + np.append(0, sizes[:-1]))
    df = spark.createDataFrame([("c", "+", 0, int(a), int(a + n - 1)) for a, n in zip(starts, sizes)], "chrom string, strand string, frame int, start long, stop long")
    genome = int(starts[-1] + sizes[-1])
    got = mixture.estimate_hmm_params(df, genome, steps=100)
    assert got[0] == pytest.approx(sizes.sum() / genome / 6) and got[1] == pytest.approx(length, rel=0.05)
    assert got[2] == pytest.approx(weights, abs=0.06) and got[3] == pytest.approx(lengths, rel=0.25)
    assert sum(got[2]) == pytest.approx(1)


def test_sample_rows(spark):
    df = spark.range(4000).select("id")
    assert mixture.sample_rows(df, 5000, F.col("id")).count() == 4000
    a = {r["id"] for r in mixture.sample_rows(df, 500, F.col("id")).collect()}
    assert 400 < len(a) < 600 and a == {r["id"] for r in mixture.sample_rows(df.repartition(5), 500, F.col("id")).collect()}
    assert a != {r["id"] for r in mixture.sample_rows(df, 500, F.col("id"), seed=1).collect()}


def test_candidate_regions(spark):
    """Classes told apart by their scores: candidates are the unannotated regions that score like coding ones, best first."""
    rng = np.random.default_rng(18)
    rows, scores = [], []
    for i in range(900):
        kind = ("CodingOverlap", "AntisenseOverlap", "NoOverlap")[i % 3]
        start, n = 1000 * i + 1, int(rng.integers(12, 60))
        good = kind == "CodingOverlap" or i % 30 == 2
        per, anti = rng.normal(8 if good else -4, 1), rng.normal(-4 if good or kind == "NoOverlap" else 8, 1)
        rows.append((f"r{i}", "c", "+", start, start + 3 * n - 1, kind, n))
        scores += [("c", start, start + 3 * n - 1, "+", "score(decibans)", per * n, 0.8), ("c", start + 2, start + 3 * n + 1, "-", "score(decibans)", anti * n, 0.8)]
    regions_df = spark.createDataFrame(rows, "rid string, chrom string, strand string, start long, stop long, reg_type string, num_codons long")
    scores_df = spark.createDataFrame(scores, "chrom string, start long, stop long, strand string, status string, raw double, bls double")
    got = sorted((r["rank"], r["rid"], r["svm_score"], r["svm_antisense_score"]) for r in scoring.candidate_regions(regions_df, scores_df, 200).collect())
    assert [r[0] for r in got] == list(range(1, len(got) + 1))
    assert all(a[2] >= b[2] for a, b in zip(got, got[1:])) and all(r[3] >= scoring.MIN_ANTISENSE for r in got)
    planted = {f"r{i}" for i in range(900) if i % 30 == 2}
    assert planted == {r[1] for r in got[: len(planted)]}


def test_mixture_recovers(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.exponential(3000, 12000), rng.exponential(90000, 4000), rng.exponential(100, 4000)]).round().astype(int)
    df = spark.createDataFrame([(int(v),) for v in x], "gap long")
    means, weights = mixture.fit_exponential_mixture(df, "gap", 3, 20)
    assert np.allclose(means, [3000, 90000, 100], rtol=0.15)
    assert np.allclose(weights, [0.6, 0.2, 0.2], atol=0.05)
    probs = mixture.class_probabilities(df.limit(50), "gap", [mixture.Exponential()] * 3, [(m,) for m in means], weights)
    assert all(abs(sum(r["class_probs"]) - 1) < 1e-9 for r in probs.collect())
    params, priors = mixture.infer_mixture(spark.createDataFrame([(float(v),) for v in np.append(rng.normal(0, 1, 500), rng.normal(9, 1, 500))], "v double"), "v", [mixture.Normal()] * 2, [(1.0, 2.0), (6.0, 2.0)], [0.5, 0.5], 15)
    assert abs(params[0][0]) < 0.3 and abs(params[1][0] - 9) < 0.3


def test_rbf_scorer(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (1200, 3))
    y = (np.linalg.norm(x, axis=1) < 1.4).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    model = scoring.fit_rbf_scorer(df.limit(800), ["a", "b", "c"], "y")
    got = scoring.score_rbf(df, model, "s").toPandas()
    order = got["s"].rank()
    n1, n0 = int(y.sum()), int((1 - y).sum())
    assert (order[got["y"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.95
    again = scoring.score_rbf(df, scoring.fit_rbf_scorer(df.limit(800), ["a", "b", "c"], "y"), "s").toPandas()
    assert np.allclose(np.sort(got["s"]), np.sort(again["s"]))


def test_sample_and_rank(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).cast("string").alias("k"), (F.col("id") % 7).alias("v"))
    a = {r["id"] for r in scoring.stratified_sample(df, "k", 40, F.col("id")).collect()}
    assert len(a) == 120 and a == {r["id"] for r in scoring.stratified_sample(df.repartition(7), "k", 40, F.col("id")).collect()}
    with pytest.raises(ValueError):
        scoring.stratified_sample(df, "k", 500, F.col("id"))
    ranked = scoring.global_rank(df, [F.desc("v"), F.asc("id")]).collect()
    want = sorted(((-r["v"], r["id"]) for r in ranked))
    assert {r["id"]: r["rank"] for r in ranked} == {i: k for k, (_, i) in enumerate(want, 1)}
    assert scoring.global_rank(df.filter("id < 0"), [F.asc("id")]).count() == 0


def test_scalars(spark):
    df = spark.createDataFrame([("acGTn",), ("AUG",)], "s string")
    rows = df.select(scalars.reverse_complement("s").alias("x"), scalars.reverse_complement("s", rna=True).alias("r")).collect()
    assert [tuple(r) for r in rows] == [("nACgt", None), (None, "CAU")]
    r = spark.range(1).select(scalars.parse_regions(F.lit("chr1:1,000-2,000+chr2:-5--1")).alias("a"), scalars.parse_regions(F.lit("chr1-5")).alias("b"), scalars.kmer_index(F.lit("ACGTACG")).alias("k"), scalars.rank_color(F.lit(9999), 10000, F.lit("+")).alias("c"), scalars.rank_color(F.lit(7), 5000, F.lit("-")).alias("d")).first()
    assert [tuple(x) for x in r["a"]] == [("chr1", 1000, 2000), ("chr2", -5, -1)] and r["b"] is None and r["k"] == 1734
    assert r["c"] == "223,245,223" and r["d"] == "200,0,0"


def test_line_ends_and_places(spark):
    texts = ["a\n", "a\r\n", "a\r", "a\n\n", "a", "", "YY"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.without_trailing_newline("t")).collect()]
    assert got == ["a", "a", "a", "a\n", "a", "", "YY"]
    r = spark.range(1).select(scalars.without_trailing_char(F.lit("xYY"), "Y"), scalars.region_string(F.lit(None).cast("string"), F.lit(1), F.lit(5)), scalars.antistrand(F.lit("."))).first()
    assert tuple(r) == ("xY", None, ".")


def test_fingerprint(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (2, "x")], "k long, t string")
    prints = [compare.fingerprint(x).first() for x in (a, a.orderBy(F.desc("k")).repartition(3), a.distinct(), a.filter("k = 1"))]
    assert prints[0] == prints[1] and len({tuple(p) for p in prints}) == 3


def test_diff_tables(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, "y"), (3, None, "z")], "k long, v double, t string")
    b = spark.createDataFrame([(1, 1.0 + 1e-12, "x"), (2, 2.1, "q"), (4, 1.0, "z")], "k long, v double, t string")
    got = {r["k"]: (r["side"], r["columns"]) for r in compare.diff_tables(a, b, ["k"]).collect()}
    assert got[2] == ("both", ["v", "t"]) and got[3][0] == "left" and got[4][0] == "right" and 1 not in got
    assert compare.tables_equal(a, a.orderBy(F.desc("k"))) and not compare.tables_equal(a, b)


def test_equal_tables_meet_in_no_join(spark):
    a = spark.range(5000).selectExpr("id", "cast(id % 7 as double) as x", "cast(id as string) as t")
    same = compare.diff_tables(a, a.repartition(3).select("t", "id", "x"), ["id"])
    assert same.count() == 0 and "Join" not in same._jdf.queryExecution().optimizedPlan().toString() and compare.tables_equal(a, a.repartition(3))
    b = a.withColumn("x", F.when(F.col("id") == 77, -1.0).otherwise(F.col("x")))
    x, y = compare._suspects(a, b, ["id"], a.columns)
    assert 1 <= x.count() < 20 and not compare.tables_equal(a, b)
    assert [tuple(r) for r in compare.diff_tables(a, b, ["id"]).collect()] == [(77, "both", ["x"])]


def test_repeated_keys_as_multisets(spark):
    kind = "k long, v string, x double"
    a = spark.createDataFrame([(1, "a", 1.0), (1, "a", 1.0), (1, "b", 2.0), (2, "c", 1.0), (None, "n", 0.0), (5, "e", 1.0)], kind)
    b = spark.createDataFrame([(1, "b", 2.0), (1, "a", 1.0), (2, "c", 1.0 + 1e-12), (None, "m", 0.0), (5, "e", 1.0), (5, "e", 1.0)], kind)
    got = sorted(map(str, map(tuple, compare.diff_tables(a, b, ["k"]).collect())))
    assert got == sorted(map(str, [(1, "left", ["v", "x"]), (None, "both", ["v"]), (5, "right", ["v", "x"])]))
    lines = [spark.createDataFrame([(i, t) for i, t in enumerate(x, 1)], "line_no long, value string") for x in (["a", "b", "c"], ["a", "x", "c", "d"])]
    assert sorted(tuple(r) for r in compare.diff_lines(*lines).select("line_no", "side", F.coalesce("left", F.lit("")), F.coalesce("right", F.lit(""))).collect()) == [(2, "both", "b", "x"), (4, "right", "", "d")]
