"""Decoding against enumeration, posteriors, buckets, and recovery of a drawn model."""

from __future__ import annotations

import itertools
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from codonweave.operators import hmm


def small() -> hmm.Hmm:
    return hmm.Hmm(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), hmm.MatrixEmissions(np.array([[0.5, 0.1], [0.3, 0.3], [0.2, 0.6]])))


def joint(model, obs, path):
    e = model.emissions(np.array(obs))
    p = model.prior[path[0]] * e[0, path[0]]
    for t in range(1, len(obs)):
        p *= model.transitions[path[t - 1], path[t]] * e[t, path[t]]
    return p


def test_against_enumeration():
    rng = np.random.default_rng(0)
    model = small()
    seqs = [rng.integers(0, 3, n) for n in (1, 2, 5, 3, 7)]
    paths = hmm.viterbi(model, seqs)
    post, logs = hmm.forward_backward(model, seqs)
    for s, path, p, log in zip(seqs, paths, post, logs):
        ways = {w: joint(model, s, w) for w in itertools.product((0, 1), repeat=len(s))}
        assert np.isclose(ways[tuple(path)], max(ways.values()))
        assert np.isclose(log, np.log(sum(ways.values())))
        for t in range(len(s)):
            assert np.isclose(p[t, 0], sum(v for w, v in ways.items() if w[t] == 0) / sum(ways.values()))
        assert np.allclose(p.sum(axis=1), 1)


def test_ties_take_last_predecessor_and_first_end():
    model = hmm.Hmm(np.array([0.5, 0.5]), np.full((2, 2), 0.5), hmm.MatrixEmissions(np.ones((1, 2))))
    assert hmm.viterbi(model, [np.zeros(3, int)])[0].tolist() == [1, 1, 0]


def test_rows_must_add_up():
    with pytest.raises(ValueError):
        hmm.Hmm(np.array([0.5, 0.4]), np.eye(2), hmm.MatrixEmissions(np.ones((1, 2))))


def test_presets_are_models():
    for preset in hmm.HMM_PRESETS.values():
        model = hmm.coding_hmm(*preset)
        assert model.transitions[1, 2] == 0


def test_blocks_do_not_depend_on_buckets(spark):
    rng = np.random.default_rng(1)
    pos = sorted({int(3 * p) for p in rng.integers(0, 400, 330)})
    df = spark.createDataFrame([("c", "+", 0, p) for p in pos], "chrom string, strand string, frame int, pos long")
    want, block = {}, None
    for i, p in enumerate(pos):
        block = p if i == 0 or pos[i - 1] + 3 != p else block
        want[p] = block
    for bucket in (1, 2, 7, 1000):
        assert {r["pos"]: r["block"] for r in hmm.assign_blocks(df, bucket).collect()} == want


def test_breaks(spark):
    rows = [("c", "+", 0, p, s, b) for p, s, b in ((3, 5.0, 1.0), (6, 5.0, 0.1), (9, 5.0, 0.2), (12, None, None), (15, 1.0, 0.5), (18, 1.0, 0.5))]
    df = spark.createDataFrame(rows, "chrom string, strand string, frame int, pos long, score double, bls double")
    got = {r["pos"]: r["block"] for r in hmm.assign_blocks(hmm.usable_codons(df)).collect()}
    assert got == {3: 3, 9: 9, 15: 15, 18: 15}


def test_recovers_runs(spark):
    score = [-5.0] * 300 + [12.0] * 60 + [-5.0] * 300
    df = spark.createDataFrame([("c", "+", 0, 3 * i, s, 1.0) for i, s in enumerate(score)], "chrom string, strand string, frame int, pos long, score double, bls double")
    rows = hmm.coding_regions(df).collect()
    assert [(r["start"], r["stop"]) for r in rows] == [(900, 1079)]
    assert rows[0]["gray"] <= 60


def test_sequences_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rng = np.random.default_rng(2)
    seqs = {k: rng.integers(0, 3, n) for k, n in enumerate((1, 30, 5, 18, 2))}
    df = spark.createDataFrame([(k, i, int(o)) for k, s in seqs.items() for i, o in enumerate(s)], "k long, i long, obs long")
    got = hmm.hmm_decode(df, ["k"], ["i"], "obs", small()).orderBy("k", "i").groupBy("k").agg(F.collect_list(F.struct("i", "state")).alias("x")).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = dict(zip(seqs, hmm.viterbi(small(), list(seqs.values()))))
    for r in got:
        assert [x["state"] for x in sorted(r["x"])] == want[r["k"]].tolist()


def test_chunks_do_not_change_the_result(spark):
    rng = np.random.default_rng(3)
    rows = [(k, i, float(rng.normal(0, 9))) for k, n in enumerate((1, 8, 7, 9, 64, 3, 200)) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, i long, obs double")
    model = hmm.coding_hmm(*hmm.HMM_PRESETS["fly"])
    want = {(r["k"], r["i"]): (r["state"], r["posterior"]) for r in hmm.hmm_decode(df, ["k"], ["i"], "obs", model, posteriors=True).collect()}
    for size in (8, 50):
        got = hmm.hmm_decode(df, ["k"], ["i"], "obs", model, posteriors=True, chunk=F.floor(F.col("i") / size))
        assert got.columns == ["k", "i", "obs", "state", "posterior"]
        rows_got = {(r["k"], r["i"]): (r["state"], r["posterior"]) for r in got.collect()}
        assert {k: v[0] for k, v in rows_got.items()} == {k: v[0] for k, v in want.items()}
        assert all(np.allclose(v[1], want[k][1], atol=1e-12) for k, v in rows_got.items())
    plain = hmm.hmm_decode(df, ["k"], ["i"], "obs", model, chunk=F.floor(F.col("i") / 50))
    assert plain.count() == len(want) and "posterior" not in plain.columns


def test_ties_over_chunks():
    model = hmm.Hmm(np.array([0.5, 0.5]), np.full((2, 2), 0.5), hmm.MatrixEmissions(np.ones((1, 2))))
    obs, starts = np.zeros(9, int), np.array([0, 4, 8])
    before = np.array([[np.nan] * 2, [1, 1], [1, 1]])
    vectors = hmm.join_chunks(*hmm.transfer_matrices(model, hmm.Sequences(obs, starts, before)))
    assert hmm.best_states(model, hmm.Sequences(obs, starts, *vectors)).tolist() == hmm.viterbi(model, [obs])[0].tolist()


def test_long_and_short_blocks_in_bounded_memory():
    """Two million codons in chunks beside 100,000 short blocks, under 1 GB; the paths of a part are those of the whole kernel."""
    rng = np.random.default_rng(4)
    model = hmm.coding_hmm(*hmm.HMM_PRESETS["human"])
    lengths = np.concatenate((rng.integers(1, 30, 100_000), [6000]))
    obs = rng.normal(-2, 8, lengths.sum())
    short = hmm.Sequences(obs, np.cumsum(lengths) - lengths)
    long = rng.normal(-2, 8, 2_000_000)
    starts = np.arange(0, len(long), hmm.CHUNK)
    before = np.ones((len(starts), 4))
    before[0] = np.nan
    tracemalloc.start()
    path, post = hmm.best_states(model, short), hmm.posterior_states(model, short)[0]
    vectors = hmm.join_chunks(*hmm.transfer_matrices(model, hmm.Sequences(long, starts, before)))
    whole = hmm.Sequences(long, starts, *vectors)
    long_path, long_post = hmm.best_states(model, whole), hmm.posterior_states(model, whole)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1e9, peak
    assert np.array_equal(path[-6000:], hmm.viterbi(model, [obs[-6000:]])[0]) and np.allclose(post.sum(axis=1), 1)
    assert np.allclose(long_post.sum(axis=1), 1) and (long_path == 0).any()
    # three chunks of their own agree with the unchunked kernel
    part = long[: 3 * hmm.CHUNK]
    vectors = hmm.join_chunks(*hmm.transfer_matrices(model, hmm.Sequences(part, starts[:3], before[:3])))
    assert np.array_equal(hmm.best_states(model, hmm.Sequences(part, starts[:3], *vectors)), hmm.viterbi(model, [part])[0])


def test_long_sequences_in_numbered_chunks(spark):
    """Sequences without positions are numbered over range partitions; paths, posteriors and likelihoods are those of the plain kernel."""
    rng = np.random.default_rng(9)
    rows = [(k, i, float(rng.normal(0, 9)), {"i": i}) for k, n in ((1, 700), (2, 3), (None, 20), (4, 64)) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, i long, obs double, note map<string,bigint>").repartition(5)
    model = hmm.coding_hmm(*hmm.HMM_PRESETS["fly"])
    numbered = hmm.chunk_numbers(df, ["k"], ["i"], 64)
    got = {(r["k"], r["i"]): r[hmm._NUMBER] for r in numbered.collect()}
    assert got == {(k, i): i // 64 if k == 1 else 0 for k, i, _, _ in rows}
    assert hmm.chunk_numbers(df, ["k"], ["i"], 700) is None
    want = {(r["k"], r["i"]): (r["state"], r["posterior"]) for r in hmm.hmm_decode(df, ["k"], ["i"], "obs", model, posteriors=True).collect()}
    chunked = hmm.hmm_decode(df, ["k"], ["i"], "obs", model, posteriors=True, chunk=64)
    assert chunked.columns == [*df.columns, "state", "posterior"]
    rows_got = chunked.filter("k is not null").collect()
    assert len(rows_got) == 767 and all(r["state"] == want[r["k"], r["i"]][0] and np.allclose(r["posterior"], want[r["k"], r["i"]][1], atol=1e-9) for r in rows_got)
    plain = {r["k"]: r["log_likelihood"] for r in hmm.hmm_log_likelihood(df, ["k"], ["i"], "obs", model).collect()}
    parts = {r["k"]: r["log_likelihood"] for r in hmm.hmm_log_likelihood(df, ["k"], ["i"], "obs", model, chunk=64).collect()}
    assert set(parts) == set(plain) and all(abs(parts[k] - plain[k]) < 1e-9 * abs(plain[k]) for k in plain)


def test_regions_leave_the_kernel(spark):
    """Segments of chunks are joined at the chunks' ends; as many rows leave the tasks as there are segments, not codons."""
    rng = np.random.default_rng(10)
    rows = []
    for block, n in ((0, 900), (1000, 40), (1100, 1), (1200, 65)):
        x = np.repeat(rng.choice([-25.0, 25.0], n // 20 + 1), 20)[:n]
        rows += [("c", "+", 1, 3 * (block + i), float(s), 1.0) for i, s in enumerate(x)]
    df = spark.createDataFrame(rows, "chrom string, strand string, frame int, pos long, score double, bls double")
    model = hmm.coding_hmm(*hmm.HMM_PRESETS["human"])
    blocks = hmm.assign_blocks(hmm.usable_codons(df))
    want = sorted(tuple(r)[3:6] for r in hmm.coding_runs(hmm.hmm_decode(blocks, ["chrom", "strand", "frame", "block"], ["pos"], "score", model, posteriors=True)).collect())
    for chunk in (4096, 64, 7):
        got = sorted(tuple(r)[3:6] for r in hmm.coding_regions(df, model, chunk=chunk).collect())
        assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-6)
    keyed = blocks.select("chrom", "strand", F.col("frame").cast("long").alias("frame"), F.col("block").cast("long").alias("block"), "pos", "score")
    out = hmm.hmm_decode(keyed, ["chrom", "strand", "frame", "block"], ["pos"], "score", model, summary=(hmm.SEGMENT, hmm.coding_segments))
    assert out.count() == len(want) < 40 and out.schema == hmm.SEGMENT
