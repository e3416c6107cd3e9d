"""Parameter estimation: exon pruning, gaps, coding statistics, and mixtures by EM on aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codonweave.operators.intervals import SWEEP, clusters, gaps
from codonweave.session import discard, materialize

KEYS = ["chrom", "strand", "frame"]
_EXON = "struct<start:bigint,stop:bigint>"


def _fold(exons: Column, entering: Column) -> Column:
    """Sorted exons gone through from left to right, with an exon that comes in (or null): kept, those that nothing later can meet, and last, the one that goes on."""

    def step(acc: Column, x: Column) -> Column:
        last = acc["last"]
        apart = F.struct(F.concat(acc["kept"], F.array(last)).alias("kept"), x.alias("last"))
        longer = F.struct(acc["kept"].alias("kept"), x.alias("last"))
        return F.when(last.isNull(), longer).when(x["start"] > last["stop"], apart).when(x["stop"] - x["start"] > last["stop"] - last["start"], longer).otherwise(acc)

    start = F.struct(F.array().cast(f"array<{_EXON}>").alias("kept"), entering.cast(_EXON).alias("last"))
    return F.aggregate(exons, start.cast(f"struct<kept:array<{_EXON}>,last:{_EXON}>"), step)


def prune_overlaps(exons: DataFrame, keys: list[str] = KEYS, width: int = SWEEP) -> DataFrame:
    """Of overlapping exons the longer stays (the earlier of equals), from left to right, by key.

    Of one start only the longest can stay. Only exons of one chain of overlaps can meet, so chains are folded by themselves,
    bin by bin of starts, of which none has more rows than bases. Nearly all chains lie in one bin. Those over several are folded as if
    nothing came into a bin, and once more with what the bin before hands on, until that no longer changes."""
    own = exons.select(*keys, F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))
    rows = materialize(clusters(own, keys, width))
    groups = rows.groupBy("_k", "_bin", "_island").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("exons"))
    over, none = rows.filter("_over").select("_k", "_island").distinct(), F.lit(None).cast(_EXON)
    done = groups if over.isEmpty() else groups.join(over, ["_k", "_island"], "left_anti")
    folded = _fold(F.col("exons"), none)
    alone = F.when(F.size("exons") == 1, F.col("exons")).otherwise(F.concat(folded["kept"], F.array(folded["last"])))
    out = done.select("_k", F.explode(alone).alias("x"))
    if done is not groups:
        parts = materialize(groups.join(over, ["_k", "_island"], "left_semi"))
        w = W.partitionBy("_k", "_island").orderBy("_bin")
        states = materialize(parts.select("_k", "_island", "_bin", none.alias("entering"), folded["last"].alias("leaving")))
        while True:
            came = states.select("_k", "_island", "_bin", "entering", F.lag("leaving").over(w).alias("next"), F.lead("_bin").over(w).isNull().alias("ends"))
            came = materialize(came)
            if came.filter(~F.col("entering").eqNullSafe(F.col("next"))).isEmpty():
                break
            again = parts.join(came.select("_k", "_island", "_bin", "next"), ["_k", "_island", "_bin"])
            before, states = states, materialize(again.select("_k", "_island", "_bin", F.col("next").alias("entering"), _fold(F.col("exons"), F.col("next"))["last"].alias("leaving")))
            discard(before, came)
        found = _fold(F.col("exons"), F.col("entering"))
        ended = parts.join(came, ["_k", "_island", "_bin"]).select("_k", found.alias("_f"), "ends")
        out = out.unionByName(ended.select("_k", F.explode(F.when(F.col("ends"), F.concat(F.col("_f.kept"), F.array("_f.last"))).otherwise(F.col("_f.kept"))).alias("x")))
        discard(states)
    return out.select(*[F.col(f"_k.`{k}`") for k in keys], "x.start", "x.stop")


def exon_gaps(pruned: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Bases between neighbours, where there are any."""
    return gaps(pruned, keys).select(*keys, (F.col("stop") - F.col("start") + 1).alias("gap"))


def coding_stats(pruned: DataFrame, genome_length: int) -> DataFrame:
    """One row: exons, coding bases, coding prior (six frames), mean length in codons."""
    size = F.col("stop") - F.col("start") + 1
    out = pruned.agg(F.count("*").alias("exons"), F.coalesce(F.sum(size), F.lit(0)).alias("bases"))
    return out.select("exons", "bases", (F.col("bases") / genome_length / 6).alias("prior"), (F.col("bases") / F.col("exons") / 3).alias("codons"))


def sample_rows(df: DataFrame, most: int, key: Column, seed: int = 0) -> DataFrame:
    """About `most` rows at most, chosen by a hash of the key; the same for the same data and seed."""
    n = df.count()
    if n <= most:
        return df
    return df.filter(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) < F.lit(int(most / n * (1 << 40))))


class Exponential:
    """Log density and weighted estimate of an exponential distribution with mean params[0]."""

    def log_density(self, x: Column, params: tuple[float, ...]) -> Column:
        return -x / params[0] - math.log(params[0])

    def sums(self, x: Column) -> list[Column]:
        return [x]

    def estimate(self, weight: float, sums: list[float]) -> tuple[float, ...]:
        return (sums[0] / weight,)


class Normal:
    """The same of a normal distribution with mean and deviation."""

    def log_density(self, x: Column, params: tuple[float, ...]) -> Column:
        return -((x - params[0]) ** 2) / (2 * params[1] ** 2) - math.log(params[1] * math.sqrt(2 * math.pi))

    def sums(self, x: Column) -> list[Column]:
        return [x, x * x]

    def estimate(self, weight: float, sums: list[float]) -> tuple[float, ...]:
        mean = sums[0] / weight
        return (mean, math.sqrt(max(sums[1] / weight - mean * mean, 1e-12)))


def _responsibilities(x: Column, parts: list, params: list[tuple[float, ...]], priors: list[float]) -> list[Column]:
    """Class probabilities of a value; all alike where every density underflows."""
    dens = [F.lit(p) * F.exp(d.log_density(x, q)) for d, q, p in zip(parts, params, priors)]
    total = sum(dens[1:], dens[0])
    return [F.when(total > 0, d / total).otherwise(F.lit(1.0 / len(parts))) for d in dens]


def infer_mixture(df: DataFrame, column: str, parts: list, params: list[tuple[float, ...]], priors: list[float], steps: int = 20) -> tuple[list[tuple[float, ...]], list[float]]:
    """Parameters and priors of a mixture after so many EM steps over all rows.

    Rows with equal values are counted once; each step is one aggregate to a single row."""
    hist = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").alias("n")).cache()
    try:
        for _ in range(steps):
            r = _responsibilities(F.col("x"), parts, params, priors)
            aggs = [F.sum("n").alias("total")]
            for j, d in enumerate(parts):
                aggs.append(F.sum(F.col("n") * r[j]).alias(f"w{j}"))
                aggs += [F.sum(F.col("n") * r[j] * s).alias(f"s{j}_{k}") for k, s in enumerate(d.sums(F.col("x")))]
            row = hist.agg(*aggs).first()
            if not row["total"]:
                break
            priors = [row[f"w{j}"] / row["total"] for j in range(len(parts))]
            params = [d.estimate(row[f"w{j}"], [row[f"s{j}_{k}"] for k in range(len(d.sums(F.col("x"))))]) if row[f"w{j}"] > 0 else q for j, (d, q) in enumerate(zip(parts, params))]
    finally:
        hist.unpersist()
    return params, priors


def class_probabilities(df: DataFrame, column: str, parts: list, params: list[tuple[float, ...]], priors: list[float]) -> DataFrame:
    """df with class_probs: the probability of each part for each row."""
    return df.withColumn("class_probs", F.array(*_responsibilities(F.col(column).cast("double"), parts, params, priors)))


#: Guesses for the means of gaps (bases) and their weights.
GUESSES, WEIGHTS = (3e3, 8e4, 1e2), (30.0, 10.0, 1.0)


def fit_exponential_mixture(df: DataFrame, column: str, k: int = 3, steps: int = 20) -> tuple[list[float], list[float]]:
    """Mean lengths and weights of a mixture of one to three exponentials."""
    total = sum(WEIGHTS[:k])
    params, priors = infer_mixture(df, column, [Exponential()] * k, [(g,) for g in GUESSES[:k]], [w / total for w in WEIGHTS[:k]], steps)
    return [p[0] for p in params], priors


def estimate_hmm_params(exons: DataFrame, genome_length: int, k: int = 3, steps: int = 20) -> tuple[float, float, tuple[float, ...], tuple[float, ...]]:
    """(coding prior, coding length, weights, lengths) for coding_hmm(); lengths in codons."""
    pruned = prune_overlaps(exons).cache()
    try:
        stats = coding_stats(pruned, genome_length).first()
        means, weights = fit_exponential_mixture(exon_gaps(pruned), "gap", k, steps)
    finally:
        pruned.unpersist()
    return stats["prior"], stats["codons"], tuple(weights), tuple(m / 3 for m in means)
