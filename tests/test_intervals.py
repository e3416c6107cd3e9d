"""Sweeps and overlap joins over any bounds, hot bins, and positions with repeated rows and equal names."""

from __future__ import annotations

import random
import time
from collections import Counter

from pyspark.sql import functions as F

from codonweave.operators import intervals, transcripts
from codonweave.sources import readers

KINDS = "k string, start long, stop long"
BIG = 1 << 62


def merged(rows):
    """Islands of each key, one after another."""
    out = []
    for k, a, b in sorted((r for r in rows if r[1] is not None and r[2] is not None and r[1] <= r[2]), key=lambda r: (str(r[0]), r[1])):
        if out and out[-1][0] == k and a <= out[-1][2] + 1:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([k, a, b])
    return sorted((tuple(x) for x in out), key=str)


def rest(rows, lo, hi):
    """What merged() leaves from lo to hi, by key."""
    out, at = [], {k: lo for k, _, _ in rows}
    for k, a, b in sorted(merged(rows), key=lambda r: (str(r[0]), r[1])):
        if a - 1 >= at[k]:
            out.append((k, at[k], min(a - 1, hi)))
        at[k] = max(at[k], b + 1)
    return sorted([x for x in out if x[1] <= x[2]] + [(k, a, hi) for k, a in at.items() if a <= hi], key=str)


def spread(seed, n=150):
    """Intervals about edges of bins, groups of bins and groups of groups, from one base to 2^45 long; nulls and empty ones too."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        start = rng.choice([0, 1 << 16, 1 << 32, 1 << 48, -(1 << 32), 5 << 16, BIG - 100, -BIG]) + rng.randrange(0, 60)
        size = rng.choice([0, 1, 5, 30, 30, 1 << 16, (1 << 16) + 7] + [1 << 33] * (rng.random() < 0.1))
        rows.append((rng.choice(["a", "b", None]), start, min(start + size, BIG)))
    return [*rows, rows[0], rows[0], ("a", None, 5), ("b", 9, 3), ("c", 7 << 40, (7 << 40) + (1 << 45)), ("c", (7 << 40) + (1 << 45) + 1, (8 << 40) + (1 << 45))]


def test_sweeps_against_a_loop(spark, monkeypatch):
    for seed, many in ((1, 0), (2, intervals.MANY_BINS)):  # by groups of bins, and without
        monkeypatch.setattr(intervals, "MANY_BINS", many)
        rows = spread(seed)
        df = spark.createDataFrame(rows, KINDS).repartition(3)
        assert sorted((tuple(r) for r in intervals.union_regions(df, ["k"]).select("k", "start", "stop").collect()), key=str) == merged(rows)
        got = intervals.complement_region(df, ["k"], -BIG, BIG).select("k", "start", "stop")
        assert sorted((tuple(r) for r in got.collect()), key=str) == rest(rows, -BIG, BIG)
    assert intervals.union_regions(df.limit(0), ["k"]).count() == 0


def test_any_bounds_cost_what_their_intervals_do(spark):
    df = spark.createDataFrame([("x", 5, 9), ("x", 100, 1 << 45)], KINDS)
    intervals.complement_region(df, ["k"], -5, 5).count()
    began = time.time()
    got = sorted(tuple(r) for r in intervals.complement_region(df, ["k"], -BIG, BIG).collect())
    assert got == [("x", -BIG, 4), ("x", 10, 99), ("x", (1 << 45) + 1, BIG)] and time.time() - began < 10
    assert [tuple(r) for r in intervals.union_regions(df.filter("start = 100"), ["k"]).collect()] == [("x", 100, 1 << 45)]
    plan = intervals.complement_region(df, ["k"], -BIG, BIG)._jdf.queryExecution().toString()
    assert "sequence(" not in plan and "Generate" not in plan


def test_subtraction_of_long_intervals(spark):
    a = [("r1", "x", 0, 1 << 45), ("r2", "x", 50, 60), ("r3", "y", 1, 9), ("r4", None, 1, 9), ("r5", "x", 1 << 50, (1 << 50) + 3)]
    b = [("x", 10, 20), ("x", 40, 70), ("x", (1 << 44), (1 << 44) + 5), (None, 1, 5)]
    got = intervals.subtract_regions(spark.createDataFrame(a, "row string, " + KINDS), spark.createDataFrame(b, KINDS), ["k"], "row")
    want = [("r1", "x", 0, 9), ("r1", "x", 21, 39), ("r1", "x", 71, (1 << 44) - 1), ("r1", "x", (1 << 44) + 6, 1 << 45), ("r3", "y", 1, 9), ("r4", None, 1, 9), ("r5", "x", 1 << 50, (1 << 50) + 3)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def pairs_of(a, b):
    return Counter((i, j) for i, (k, s, e) in enumerate(a) for j, (k2, s2, e2) in enumerate(b) if k is not None and k == k2 and None not in (s, e, s2, e2) and s <= e and s2 <= e2 and s <= e2 and s2 <= e)


def test_overlaps_of_all_lengths(spark, monkeypatch):
    """Long ones against short ones both ways, on either side of zero; hot bins are dealt out without a pair lost or seen twice."""
    a, b = spread(3, 120), spread(4, 120)
    da, db = (spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], f"{name} long, {KINDS}") for name, rows in (("i", a), ("j", b)))
    want = pairs_of(a, b)
    for hot in (1 << 14, 3):
        monkeypatch.setattr(intervals, "HOT", hot)
        for width in (1, 1 << 12):
            assert Counter((r["i"], r["j"]) for r in intervals.overlap_join(da, db, ["k"], width).select("i", "j").collect()) == want
    semi = {r["i"] for r in intervals.overlap_join(da, db, ["k"], how="left_semi").collect()}
    anti = [r["i"] for r in intervals.overlap_join(da, db, ["k"], how="left_anti").collect()]
    assert semi == {i for i, _ in want} and sorted(anti) == sorted(set(range(len(a))) - semi)


def test_hot_bins_are_dealt_over_many_shares(spark, monkeypatch):
    monkeypatch.setattr(intervals, "HOT", 200)
    points = spark.range(4000).select(F.lit("k").alias("k"), (F.col("id") % 4000).alias("start"), (F.col("id") % 4000).alias("stop"), "id")
    base = 12
    side = intervals._Side(points, "start", "stop")
    counts = side.spots(["k"], base)
    points = side.rows
    hot = intervals._hot(counts, counts, ["k"], [base], False)
    assert [tuple(r) for r in hot.select("_s", "_p").collect()] == [(20, 20)]
    own = intervals._dealt(intervals._own_spots(points, "start", "stop", base), hot, ["k"], True, True)
    shares = {tuple(r)[:2]: r["count"] for r in own.groupBy("_s", "_p").count().collect()}
    assert len(shares) == 400 and max(shares.values()) < 2 * 200
    assert intervals.overlap_join(points, points.withColumnRenamed("id", "other"), ["k"]).count() == 4000


def test_existence_takes_any_columns(spark):
    rows = spark.createDataFrame([({"x": 1}, "a", 1, 5), ({"x": 1}, "a", 1, 5), (None, "a", 50, 60)], "m map<string,int>, " + KINDS)
    other = spark.createDataFrame([("a", 5, 5), ("a", 4, 9)], KINDS)
    assert [r["m"] for r in intervals.overlap_join(rows, other, ["k"], how="left_semi").collect()] == [{"x": 1}] * 2
    assert [r["start"] for r in intervals.overlap_join(rows, other, ["k"], how="left_anti").collect()] == [50]


def test_repeated_positions_stay(spark):
    exons = transcripts.with_lengths(spark.createDataFrame([(t, "c", s, a, b) for t, s in (("p", "+"), ("m", "-")) for a, b in ((10, 19), (30, 34), (50, 50))], "tr_id string, chrom string, strand string, start long, stop long"))
    exons = exons.withColumns({"cs": F.lit(2).cast("long"), "ce": F.lit(13).cast("long")})
    asked = [(t, p, {"n": p}) for t in ("p", "m", "none") for p in (5, 10, 19, 20, 30, 34, 40, 50, 60, 60, 60, None)]
    df = spark.createDataFrame(asked, "tr_id string, pos long, note map<string,int>")

    def place(t, p):
        if p is None:
            return None
        u = next((c + p - a + 1 for (a, b, c) in ((10, 19, 0), (30, 34, 10), (50, 50, 15)) if a <= p <= b or a == 10 and p < a or a == 50 and p > b), None)
        return u if t == "p" or u is None else 17 - u

    want = Counter((t, p, place(t, p)) for t, p, _ in asked if t != "none")
    assert Counter((r["tr_id"], r["pos"], r["trpos"]) for r in transcripts.pos_to_trpos(df, exons).collect()) == want
    frames = Counter((r["tr_id"], r["pos"], r["frame"]) for r in transcripts.frame_of_base(df, exons).collect())
    assert frames == Counter((t, p, None if u is None else (u - 2) % 3) for (t, p, u), n in want.items() for _ in range(n))
    back = transcripts.trpos_to_pos(transcripts.pos_to_trpos(df, exons).filter("trpos is not null").select("tr_id", "trpos", F.col("pos").alias("was"), "note"), exons)
    assert all(r["pos"] == r["was"] for r in back.collect()) and back.count() == sum(n for (_, _, u), n in want.items() if u is not None)
    plan = transcripts.pos_to_trpos(df, exons)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1  # the exons', none over positions


def test_lines_of_one_name_are_transcripts_of_their_own(spark):
    lines = ["c1\t10\t30\tx\t0\t+\t10\t30\t0\t2\t5,5\t0,15", "c2\t10\t30\tx\t0\t-\t10\t30\t0\t1\t20\t0", "c3\t1\t9\ty\t0\t+\t1\t1\t0\t1\t8\t0", "c4\t1\t9\tz\t0\t+\t1\t1\t0\t1\t8\t0", "c4\t1\t9\tz\t0\t+\t1\t1\t0\t1\t8\t0"]
    rows = transcripts.transcripts_from_bed(readers.parse_bed(spark.createDataFrame([(x,) for x in lines], "value string"))).collect()
    by = {}
    for r in rows:
        by.setdefault(r["tr_id"], []).append(r)
    assert Counter(x[0]["name"] for x in by.values()) == {"x": 2, "y": 1, "z": 2} and "y" in by
    assert sorted((x[0]["chrom"], len(x), x[0]["len"], x[0]["cs"], x[0]["ce"]) for x in by.values() if x[0]["name"] == "x") == [("c1", 2, 10, 1, 10), ("c2", 1, 20, 1, 20)]


def test_points_in_boxes_whatever_is_dense(spark):
    """Crowded places, one place that repeats, large boxes and points on their edges; no share gets more than its part."""
    rng = random.Random(7)
    pts = [(k, rng.gauss(0, 1) ** 3, rng.gauss(0, 1)) for k in range(1500)] + [(1500 + k, 0.25, -0.5) for k in range(700)] + [(3000, 1.0, 2.0), (3001, None, 1.0), (3002, float("nan"), 0.0)]
    boxes = [(j, x, x + w, y, y + w) for j in range(60) for x, y, w in [(rng.gauss(0, 2), rng.gauss(0, 2), rng.choice([0.1, 1, 50]))]] + [(60, 1.0, 1.0, 2.0, 2.0), (61, 0.0, 1.0, 0.0, 2.0), (62, 5.0, 4.0, 0.0, 1.0)]
    p, b = spark.createDataFrame(pts, "k long, x double, y double"), spark.createDataFrame(boxes, "j long, xmin double, xmax double, ymin double, ymax double")
    want = Counter((k, j) for k, x, y in pts if x is not None and x == x for j, x0, x1, y0, y1 in boxes if x0 <= x <= x1 and y0 <= y <= y1)
    for share in (100, 1 << 16):
        assert Counter((r["k"], r["j"]) for r in intervals.points_in_boxes(p, b, share).select("k", "j").collect()) == want
    splits = intervals._splits([(x, y) for _, x, y in pts[:1500]], 4)
    leaves = Counter()
    for _, x, y in pts[:1500]:
        node = 1
        for level in range(4):
            node = 2 * node + ((x, y)[level % 2] > splits[node])
        leaves[node] += 1
    assert len(leaves) == 16 and max(leaves.values()) < 1.3 * 1500 / 16
