"""Hidden Markov decoding of codon scores into coding regions.

Sequences are rows that share keys, in order of a column. They are laid together by key, sorted, and decoded from
Arrow batches: sequences of like length are stepped through together, in packs of bounded size, and one that goes on
into the next batch is carried over. Long sequences can be cut into chunks that different tasks decode."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from codonweave.functions import scalars
from codonweave.session import materialize, scratch, ship

#: Codons of a bucket when blocks are assigned; blocks may cross bucket edges.
BUCKET = 1 << 20
#: Codons of a chunk of a long block; numbers of a padded pack of sequences.
CHUNK, CELLS = 1 << 12, 1 << 21

# Coding prior, mean coding length (codons), weights and mean lengths (codons) of the gaps' mixture, by species.
HMM_PRESETS = {
    "human": (0.0018577729491349902, 56.83017481932195, (0.6417673350475721, 0.2150725662530122, 0.1431600986994177), (3376.1207312280044, 122153.58921094926, 328.20142626163494)),
    "mouse": (0.0021896341760155695, 59.329475343093236, (0.643717544086626, 0.23112850841659197, 0.12515394749677808), (2684.764830024852, 103708.05331414141, 291.85282506359187)),
    "fly": (0.026522813874694712, 132.46982781088735, (0.4881037880339513, 0.2959725369315241, 0.21592367503453075), (1204.1041757499499, 13023.816348780832, 58.481616736901515)),
    "worm": (0.04189592132902114, 67.15347014666943, (0.5235551125702645, 0.3258454578240301, 0.15059942960569747), (428.96501601251316, 3997.1457299207464, 37.266297382251388)),
    "mosquito": (0.01266864049727561, 131.33128349181644, (0.4557991824202843, 0.30302892345945, 0.24117189412026765), (1985.8627005310557, 31058.442254764159, 72.295158470383157)),
}


@dataclass(frozen=True)
class Hmm:
    """prior (n), transitions (n x n), and emissions: a function of observations (m) to probabilities (m x n)."""

    prior: np.ndarray
    transitions: np.ndarray
    emissions: Callable[[np.ndarray], np.ndarray]

    def __post_init__(self) -> None:
        if not np.isclose(self.prior.sum(), 1) or not np.allclose(self.transitions.sum(axis=1), 1):
            raise ValueError("priors and rows of transitions must add up to one")


class DecibanEmissions:
    """State 0 emits 10 ** (score / 10), the others one."""

    def __init__(self, states: int) -> None:
        self.states = states

    def __call__(self, obs: np.ndarray) -> np.ndarray:
        out = np.ones((len(obs), self.states))
        out[:, 0] = 10.0 ** (obs.astype(float) / 10)
        return out


class MatrixEmissions:
    """Discrete observations 0, 1, ... with a row of probabilities by state for each."""

    def __init__(self, matrix: np.ndarray) -> None:
        self.matrix = np.asarray(matrix, float)

    def __call__(self, obs: np.ndarray) -> np.ndarray:
        return self.matrix[obs.astype(int)]


def coding_hmm(prior: float, coding_length: float, weights: tuple[float, ...], lengths: tuple[float, ...]) -> Hmm:
    """One coding and several non-coding states that never follow each other."""
    w, size = np.array(weights, float), np.array(lengths, float)
    start = np.append(prior, (1 - prior) * w * size / (w * size).sum())
    moves = np.zeros((len(w) + 1, len(w) + 1))
    moves[0, 1:] = w / w.sum() / coding_length
    moves[0, 0] = 1 - moves[0, 1:].sum()
    for i, n in enumerate(size, 1):
        moves[i, 0], moves[i, i] = 1 / n, 1 - 1 / n
    return Hmm(start, moves, DecibanEmissions(len(start)))


def _packs(lengths: np.ndarray, states: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences that are stepped through together: their numbers by falling length, their lengths, and the step and the
    column of each position, sequence by sequence. Padded, a pack has at most CELLS numbers, or is a single sequence."""
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        many = max(1, CELLS // (int(lengths[order[at]]) * states))
        own = order[at : at + many]
        sizes = lengths[own]
        columns = np.repeat(np.arange(len(own)), sizes)
        yield own, sizes, np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes), columns
        at += many


def _places(own: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the positions of a pack stand among all."""
    return np.arange(sizes.sum()) + np.repeat(starts[own] - (np.cumsum(sizes) - sizes), sizes)


@dataclass
class Sequences:
    """Observations of sequences laid one after another, and what is known at their ends.

    before: a vector of states just before each sequence, as far as it is the rest of a longer one (nan: it is not);
    after: the same behind it, for posteriors; last: its last state on the best path (-1: not known)."""

    obs: np.ndarray
    starts: np.ndarray
    before: np.ndarray | None = None
    best: np.ndarray | None = None
    after: np.ndarray | None = None
    last: np.ndarray | None = None

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(np.append(self.starts, len(self.obs)))

    @staticmethod
    def of(seqs: list[np.ndarray]) -> Sequences:
        sizes = [len(s) for s in seqs]
        return Sequences(np.concatenate(seqs), np.cumsum([0, *sizes[:-1]]))


def _first(model: Hmm, entering: np.ndarray | None, own: np.ndarray, best: bool) -> tuple[np.ndarray, np.ndarray]:
    """States at the first position before its emission, and the predecessor of each on the best path."""
    start = np.repeat(model.prior[None], len(own), axis=0)
    back = np.zeros(start.shape, np.int8)
    if entering is not None:
        rest = ~np.isnan(entering[own, 0])
        vector = entering[own][rest]
        if best:
            ways = vector[:, :, None] * model.transitions[None]
            start[rest] = ways.max(axis=1)
            back[rest] = _last_best(ways)
        else:
            start[rest] = vector @ model.transitions
    return start, back


def _last_best(ways: np.ndarray) -> np.ndarray:
    """Of equal predecessors the last."""
    return ways.shape[1] - 1 - np.argmax(ways[:, ::-1], axis=1)


def best_states(model: Hmm, seqs: Sequences) -> np.ndarray:
    """The likeliest state of each position. Of equal predecessors the last is taken, of equal final states the first."""
    out = np.empty(len(seqs.obs), np.int64)
    emissions, states = model.emissions(seqs.obs), len(model.prior)
    for own, sizes, t_of, k_of in _packs(seqs.lengths, states):
        places = _places(own, sizes, seqs.starts)
        steps, many = int(sizes[0]), len(own)
        emit = np.ones((steps, many, states))
        emit[t_of, k_of] = emissions[places]
        back = np.zeros((steps, many, states), np.int8)
        p, back[0] = _first(model, seqs.best, own, True)
        p = p * emit[0]
        end = p.copy()
        for t in range(1, steps):
            live = int(np.searchsorted(-sizes, -t))  # those longer than t
            ways = p[:live, :, None] * model.transitions[None]
            back[t, :live] = _last_best(ways)
            p = ways.max(axis=1) * emit[t, :live]
            p /= p.max(axis=1, keepdims=True)
            end[:live] = p
        now = np.argmax(end, axis=1)
        if seqs.last is not None:
            known = seqs.last[own]
            now = np.where(known >= 0, known, now)
        path = np.zeros((steps, many), np.int8)
        for t in range(steps - 1, -1, -1):
            live = int(np.searchsorted(-sizes, -t))
            path[t, :live] = now[:live]
            now[:live] = back[t, np.arange(live), now[:live]]
        out[places] = path[t_of, k_of]
    return out


def posterior_states(model: Hmm, seqs: Sequences) -> tuple[np.ndarray, np.ndarray]:
    """Posterior state probabilities of each position, and the natural log likelihood of each sequence."""
    out, states = np.empty((len(seqs.obs), len(model.prior))), len(model.prior)
    likelihood = np.zeros(len(seqs.starts))
    emissions = model.emissions(seqs.obs)
    for own, sizes, t_of, k_of in _packs(seqs.lengths, states):
        places = _places(own, sizes, seqs.starts)
        steps, many = int(sizes[0]), len(own)
        emit = np.ones((steps, many, states))
        emit[t_of, k_of] = emissions[places]
        f, logs = np.zeros((steps, many, states)), np.zeros(many)
        x = _first(model, seqs.before, own, False)[0] * emit[0]
        for t in range(steps):
            live = int(np.searchsorted(-sizes, -t))
            if t:
                x = (f[t - 1, :live] @ model.transitions) * emit[t, :live]
            scale = x.max(axis=1, keepdims=True)
            f[t, :live] = x / scale
            logs[:live] += np.log(scale[:, 0])
        likelihood[own] = logs + np.log(f[sizes - 1, np.arange(many)].sum(axis=1))
        b = np.ones((many, states))
        if seqs.after is not None:
            known = ~np.isnan(seqs.after[own, 0])
            b[known] = seqs.after[own][known]
        for t in range(steps - 1, -1, -1):
            live = int(np.searchsorted(-sizes, -t))
            f[t, :live] *= b[:live]
            x = (b[:live] * emit[t, :live]) @ model.transitions.T
            b[:live] = x / x.max(axis=1, keepdims=True)
        post = f[t_of, k_of]
        out[places] = post / post.sum(axis=1, keepdims=True)
    return out, likelihood


def transfer_matrices(model: Hmm, seqs: Sequences) -> tuple[np.ndarray, np.ndarray]:
    """For each sequence what its positions do to a vector of states before it, as two matrices of greatest element 1:
    by the best path, and by the sum of all paths. Where before is nan the prior stands in for the vector, in each row."""
    return scaled_matrices(model, seqs)[:2]


def scaled_matrices(model: Hmm, seqs: Sequences) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """transfer_matrices(), and the natural log of what the second of each was divided by."""
    states = len(model.prior)
    logs = np.zeros(len(seqs.starts))
    best, total = (np.empty((len(seqs.starts), states, states)) for _ in range(2))
    emissions = model.emissions(seqs.obs)
    for own, sizes, t_of, k_of in _packs(seqs.lengths, states * states):
        places = _places(own, sizes, seqs.starts)
        steps, many = int(sizes[0]), len(own)
        emit = np.ones((steps, many, states))
        emit[t_of, k_of] = emissions[places]
        begins = np.isnan(seqs.before[own, 0])
        one = np.where(begins[:, None, None], model.prior[None, None], model.transitions[None]) * emit[0][:, None]
        two = one.copy()
        for t in range(steps):
            live = int(np.searchsorted(-sizes, -t))
            if t:
                one[:live] = (one[:live, :, :, None] * model.transitions[None, None]).max(axis=2) * emit[t, :live, None]
                two[:live] = (two[:live] @ model.transitions) * emit[t, :live, None]
            one[:live] /= one[:live].max(axis=(1, 2), keepdims=True)
            scale = two[:live].max(axis=(1, 2), keepdims=True)
            two[:live] /= scale
            logs[own[:live]] += np.log(scale[:, 0, 0])
        best[own], total[own] = one, two
    return best, total, logs


def join_chunks(best: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the matrices of the chunks of one sequence, in order: the vectors before each chunk by all paths and by the best
    path (nan: before the first), the vector behind each, and the last state of each on the best path."""
    n, states = len(best), best.shape[1]
    before, entering = np.full((n, states), np.nan), np.full((n, states), np.nan)
    after, last = np.ones((n, states)), np.zeros(n, np.int64)
    x, y = total[0][0], best[0][0]
    for k in range(1, n):
        before[k], entering[k] = x, y
        x, y = x @ total[k], (y[:, None] * best[k]).max(axis=0)
        x, y = x / x.max(), y / y.max()
    last[n - 1] = np.argmax(y)
    for k in range(n - 1, 0, -1):
        b = total[k] @ after[k]
        after[k - 1] = b / b.max()
        ways = entering[k] * best[k][:, last[k]]
        last[k - 1] = states - 1 - np.argmax(ways[::-1])
    return before, entering, after, last


def viterbi(model: Hmm, seqs: list[np.ndarray]) -> list[np.ndarray]:
    """best_states() of separate sequences."""
    if not seqs:
        return []
    flat = Sequences.of(seqs)
    return np.split(best_states(model, flat), flat.starts[1:])


def forward_backward(model: Hmm, seqs: list[np.ndarray]) -> tuple[list[np.ndarray], list[float]]:
    """posterior_states() of separate sequences."""
    if not seqs:
        return [], []
    flat = Sequences.of(seqs)
    post, likelihood = posterior_states(model, flat)
    return np.split(post, flat.starts[1:]), likelihood.tolist()


def _whole(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole sequences out of sorted batches, and where each sequence starts; _k tells sequences apart.

    Batches are laid together once, when at least `most` rows of finished sequences are there."""
    parts: list[pa.RecordBatch] = []
    rows, last = 0, None

    def table(done: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(done)
        k = t.column("_k").to_numpy()
        return t, np.flatnonzero(np.append(True, k[1:] != k[:-1]))

    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column("_k").to_numpy()
        if rows >= most:
            cuts = np.flatnonzero(np.append(last, k[:-1]) != k)
            if len(cuts):
                head = batch.slice(0, cuts[-1])
                yield table([*parts, head] if head.num_rows else parts)
                parts, rows = [], 0
                batch = batch.slice(cuts[-1])
        parts.append(batch)
        rows += batch.num_rows
        last = k[-1]
    if parts:
        yield table(parts)


def _by_sequence(df: DataFrame, keys: list[str], order: list[str], schema: T.StructType, fn: Callable[[pa.Table, np.ndarray], pa.Table]) -> DataFrame:
    """fn(table, starts) over whole sequences, some at a time; _k is among the table's columns."""
    ship(df.sparkSession)
    laid = df.withColumn("_k", F.xxhash64(*keys)).repartition(*keys).sortWithinPartitions(*keys, *order)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _whole(batches):
            yield from fn(t, starts).select(arrow.names).cast(arrow).to_batches(max_chunksize=50_000)

    return laid.mapInArrow(run, schema)


def _lists(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(x).ravel()))


def _decoded(t: pa.Table, model: Hmm, seqs: Sequences, posteriors: bool, summary: Summary | None) -> pa.Table:
    states = best_states(model, seqs)
    if summary:
        return summary[1](t, seqs.starts, states, posterior_states(model, seqs)[0])
    t = t.append_column("state", pa.array(states))
    return t.append_column("posterior", _lists(posterior_states(model, seqs)[0])) if posteriors else t


#: The schema of what is made of decoded sequences instead of their rows, and how: from the rows, where each sequence or chunk of one
#: starts, the states and the posteriors.
Summary = tuple[T.StructType, Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], pa.Table]]


def hmm_decode(df: DataFrame, keys: list[str], order: list[str], obs: str, model: Hmm, posteriors: bool = False, chunk: Column | int | None = None, summary: Summary | None = None) -> DataFrame:
    """df with state (likeliest path) and, if wanted, posterior array<double>; or what summary makes of it, so that rows needn't leave the tasks.

    A sequence is decoded by one task, unless chunk is given: a number of each row that starts at 0, grows along a sequence and
    stays the same for a bounded number of rows. Sequences of several chunks are then decoded chunk by chunk: matrices of
    each chunk first, then the vectors at the chunks' ends from the matrices of a sequence, then the chunks with these.
    Where chunk is a number of rows, the rows of longer sequences are numbered first; columns of equal order stand as they come."""
    if isinstance(chunk, int):
        numbered = chunk_numbers(df, keys, order, chunk)
        return hmm_decode(df if numbered is None else numbered, keys, order, obs, model, posteriors, None if numbered is None else F.col(_NUMBER), summary).drop(_NUMBER)
    extra = [T.StructField("state", T.LongType())] + ([T.StructField("posterior", T.ArrayType(T.DoubleType()))] if posteriors else [])
    schema = summary[0] if summary else T.StructType(df.schema.fields + extra)

    def whole(t: pa.Table, starts: np.ndarray) -> pa.Table:
        return _decoded(t, model, Sequences(t.column(obs).to_numpy(), starts), posteriors, summary)

    if chunk is None:
        return _by_sequence(df, keys, order, schema, whole)
    cut = materialize(df.withColumn("_chunk", chunk.cast("long")))
    long = materialize(cut.filter("_chunk > 0").select(*keys).distinct())
    short = _by_sequence(cut.join(long, keys, "left_anti").drop("_chunk"), keys, order, schema, whole)
    if long.isEmpty():
        return short
    states, parts = len(model.prior), [*keys, "_chunk"]
    mine = materialize(cut.join(long, keys, "left_semi"))
    key_fields = [df.schema[k] for k in keys] + [T.StructField("_chunk", T.LongType())]

    def matrices(t: pa.Table, starts: np.ndarray) -> pa.Table:
        first = t.take(pa.array(starts))
        before = np.where((first.column("_chunk").to_numpy() == 0)[:, None], np.nan, np.ones((len(starts), states)))
        best, total = transfer_matrices(model, Sequences(t.column(obs).to_numpy(), starts, before))
        return first.append_column("_best", _lists(best.reshape(len(starts), -1))).append_column("_total", _lists(total.reshape(len(starts), -1)))

    lists = [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("_best", "_total")]
    steps = _by_sequence(mine, parts, order, T.StructType(key_fields + lists), matrices)
    vectors = [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("_before", "_entering", "_after")] + [T.StructField("_last", T.LongType())]

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk", ignore_index=True)
        before, entering, after, last = join_chunks(*(np.stack(pdf[n].to_numpy()).reshape(-1, states, states) for n in ("_best", "_total")))
        return pdf[parts].assign(_before=list(before), _entering=list(entering), _after=list(after), _last=last)

    # a chunk's vectors come as a row before its first, so they are not repeated in each
    known = steps.groupBy(*keys).applyInPandas(ends, T.StructType(key_fields + vectors))
    rows = mine.withColumn("_data", F.lit(1)).unionByName(known.withColumn("_data", F.lit(0)), allowMissingColumns=True)

    def chunks(t: pa.Table, starts: np.ndarray) -> pa.Table:
        heads = t.take(pa.array(starts))
        data = np.ones(len(t), bool)
        data[starts] = False
        own = t.filter(pa.array(data)).drop_columns(["_before", "_entering", "_after", "_last"])
        vector = {n: np.array(heads.column(n).to_pylist(), float) for n in ("_before", "_entering", "_after")}
        seqs = Sequences(own.column(obs).to_numpy(), starts - np.arange(len(starts)), vector["_before"], vector["_entering"], vector["_after"], heads.column("_last").to_numpy())
        return _decoded(own, model, seqs, posteriors, summary)

    return short.unionByName(_by_sequence(rows, parts, ["_data", *order], schema, chunks))


def hmm_log_likelihood(df: DataFrame, keys: list[str], order: list[str], obs: str, model: Hmm, chunk: int | None = None) -> DataFrame:
    """One row of keys and log_likelihood for each sequence.

    chunk: rows of a chunk. Sequences of more are scored chunk by chunk; a chunk's matrix and the log of its scale are its share, and
    a sequence's are multiplied in order, one row a chunk."""
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("log_likelihood", T.DoubleType())])

    def fn(t: pa.Table, starts: np.ndarray) -> pa.Table:
        logs = posterior_states(model, Sequences(t.column(obs).to_numpy(), starts))[1]
        return t.select(keys).take(pa.array(starts)).append_column("log_likelihood", pa.array(logs))

    numbered = None if chunk is None else chunk_numbers(df, keys, order, chunk)
    if numbered is None:
        return _by_sequence(df, keys, order, schema, fn)
    states, lists = len(model.prior), [T.StructField("_total", T.ArrayType(T.DoubleType())), T.StructField("_log", T.DoubleType())]

    def matrices(t: pa.Table, starts: np.ndarray) -> pa.Table:
        first = t.select([*keys, _NUMBER]).take(pa.array(starts))
        before = np.where((first.column(_NUMBER).to_numpy() == 0)[:, None], np.nan, np.ones((len(starts), states)))
        _, total, logs = scaled_matrices(model, Sequences(t.column(obs).to_numpy(), starts, before))
        return first.append_column("_total", _lists(total.reshape(len(starts), -1))).append_column("_log", pa.array(logs))

    def multiplied(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(_NUMBER, ignore_index=True)
        totals = np.stack(pdf["_total"].to_numpy()).reshape(-1, states, states)
        x, log = totals[0][0], float(pdf["_log"].sum())
        for m in totals[1:]:
            x = x @ m
            log += math.log(x.max())
            x = x / x.max()
        return pdf[keys].iloc[:1].assign(log_likelihood=log + math.log(x.sum()))

    parts = _by_sequence(numbered, [*keys, _NUMBER], order, T.StructType([df.schema[k] for k in keys] + [T.StructField(_NUMBER, T.LongType())] + lists), matrices)
    return parts.groupBy(*keys).applyInPandas(multiplied, schema)


_NUMBER = "_chunk_number"
#: Offsets that are broadcast at most.
_FEW = 100_000


def chunk_numbers(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame | None:
    """df with the number of each row's chunk of `size` rows along its sequence; None where no sequence has more than one.

    Rows are dealt and sorted by range, so a long sequence lies in many partitions; a row's number is its place in its
    partition, from the ids that Spark gives in order, and an offset, of which there is one a partition and long sequence."""
    if df.groupBy(*keys).count().filter(F.col("count") > size).isEmpty():
        return None
    laid = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    laid = materialize(laid.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}))
    per = laid.groupBy(*keys, "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    w = W.partitionBy(*keys).orderBy("_part")
    offsets = per.withColumns({"_all": F.sum("_n").over(W.partitionBy(*keys)), "_off": F.sum("_n").over(w) - F.col("_n") - F.col("_first")})
    offsets = materialize(offsets.filter(F.col("_all") > size).select(*keys, "_part", "_off"))
    out = laid.join(F.broadcast(offsets) if offsets.count() <= _FEW else offsets, [*keys, "_part"], "left")
    number = F.coalesce(F.floor((F.col("_place") + F.col("_off")) / size), F.lit(0)).cast("long")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], number.alias(_NUMBER))


def usable_codons(df: DataFrame, min_bls: float = 0.1) -> DataFrame:
    """Aligned codons with enough branch length."""
    return df.filter(F.col("score").isNotNull() & (F.col("bls") > min_bls))


def assign_blocks(codons: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Usable codons with block: the first position of their run of adjacent codons.

    Windows run inside buckets of positions; runs that meet at a bucket's edge are joined through the table of runs that
    touch an edge, so no task gets a whole chromosome."""
    keys = ["chrom", "strand", "frame"]
    df = codons.withColumn("_b", F.floor(F.col("pos") / (3 * bucket)))
    w = W.partitionBy(*keys, "_b").orderBy("pos")
    new = F.coalesce(F.col("pos") != F.lag("pos").over(w) + 3, F.lit(True))
    df = df.withColumn("_new", new).withColumn("_s", F.max(F.when(F.col("_new"), F.col("pos"))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = df.groupBy(*keys, "_b", "_s").agg(F.max("pos").alias("_e"))
    at_edge = ((F.col("_s") - 3) < F.col("_b") * 3 * bucket) | ((F.col("_e") + 3) >= (F.col("_b") + 1) * 3 * bucket)
    edge = runs.filter(at_edge)
    v = W.partitionBy(*keys).orderBy("_s")
    joined = edge.withColumn("_j", F.coalesce(F.col("_s") != F.lag("_e").over(v) + 3, F.lit(True)))
    joined = joined.withColumn("block", F.max(F.when(F.col("_j"), F.col("_s"))).over(v.rowsBetween(W.unboundedPreceding, 0))).filter("block <> _s").select(*keys, "_s", "block")
    return df.join(joined, [*keys, "_s"], "left").withColumn("block", F.coalesce("block", "_s")).drop("_b", "_new", "_s")


def coding_runs(decoded: DataFrame) -> DataFrame:
    """Decoded codons (pos, state, posterior) to coding regions: chrom, strand, frame, start, stop, log_odds, gray.

    A region is a run of adjacent coding codons; such runs are found as blocks are, by buckets of positions."""
    coding = decoded.filter("state = 0").select("chrom", "strand", "frame", "pos", F.col("posterior")[0].alias("p"))
    runs = assign_blocks(coding).groupBy("chrom", "strand", "frame", F.col("block").alias("start")).agg((F.max("pos") + 2).alias("stop"), F.max("p").alias("p"))
    out = runs.withColumn("log_odds", scalars.prob_to_log_odds("p"))
    return out.select("chrom", "strand", "frame", "start", "stop", "log_odds", scalars.gray_scale("log_odds").alias("gray"))


SEGMENT = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("chrom", "strand")], *[T.StructField(n, T.LongType()) for n in ("frame", "block", "start", "stop")],
    T.StructField("p", T.DoubleType()), T.StructField("edge", T.BooleanType()),
])


def coding_segments(t: pa.Table, starts: np.ndarray, states: np.ndarray, posteriors: np.ndarray) -> pa.Table:
    """Runs of coding codons of decoded blocks or chunks of blocks, with their greatest posterior; edge: they touch an end of theirs."""
    coding = states == 0
    first = np.zeros(len(coding) + 1, bool)
    first[starts], first[-1] = True, True
    begin = np.flatnonzero(coding & (first[:-1] | ~np.append(False, coding[:-1])))
    end = np.flatnonzero(coding & (first[1:] | ~np.append(coding[1:], False)))
    p = np.maximum.reduceat(np.where(coding, posteriors[:, 0], -np.inf), begin) if len(begin) else np.empty(0)
    pos = t.column("pos").to_numpy()
    heads = t.select(["chrom", "strand", "frame", "block"]).take(pa.array(begin))
    for name, x in (("start", pos[begin]), ("stop", pos[end] + 2), ("p", p), ("edge", first[begin] | first[end + 1])):
        heads = heads.append_column(name, pa.array(x))
    return heads


def joined_segments(segments: DataFrame) -> DataFrame:
    """(chrom, strand, frame, start, stop, p): segments of one block that follow each other without a gap are one.

    Only those at an edge can; there are two a chunk at most."""
    keys = ["chrom", "strand", "frame", "block"]
    w = W.partitionBy(*keys).orderBy("start")
    new = F.when(F.coalesce(F.col("start") != F.lag("stop").over(w) + 1, F.lit(True)), F.col("start"))
    edge = segments.filter("edge").withColumn("_new", new).withColumn("_run", F.max("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    edge = edge.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.max("p").alias("p"))
    names = ["chrom", "strand", "frame", "start", "stop", "p"]
    return segments.filter("not edge").select(*names).unionByName(edge.select(*names))


def coding_regions(codons: DataFrame, model: Hmm | None = None, min_bls: float = 0.1, chunk: int = CHUNK) -> DataFrame:
    """Codon scores (chrom, strand, frame, pos, score, bls) to coding regions (chrom, strand, frame, start, stop, log_odds, gray), all chromosomes in one job.

    Blocks of more than chunk codons are decoded in chunks. The decoding tasks return runs of coding codons, not codons; these are written,
    and what was written on the way there is deleted."""
    model = model or coding_hmm(*HMM_PRESETS["human"])
    blocks = assign_blocks(usable_codons(codons, min_bls)).select("chrom", "strand", F.col("frame").cast("long").alias("frame"), F.col("block").cast("long").alias("block"), F.col("pos").cast("long").alias("pos"), "score")
    part = F.floor((F.col("pos") - F.col("block")) / (3 * chunk))
    with scratch() as keep:
        segments = hmm_decode(blocks, ["chrom", "strand", "frame", "block"], ["pos"], "score", model, chunk=part, summary=(SEGMENT, coding_segments))
        runs = keep(materialize(joined_segments(segments)))
    out = runs.withColumn("frame", F.col("frame").cast(codons.schema["frame"].dataType)).withColumn("log_odds", scalars.prob_to_log_odds("p"))
    return out.select("chrom", "strand", "frame", "start", "stop", "log_odds", scalars.gray_scale("log_odds").alias("gray"))
