"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its hashed character n-grams. From the learning sample each n-gram gets the log
ratio of its smoothed shares in toxic and other texts; the most telling are kept, scaled by it, and
weighted by a logistic regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonweave.llm.classify import bounded_sample, held_out, letters, ngrams
from codonweave.llm.common import map_rows

SIZES, BITS = (4, 5, 6), 20
#: Labelled texts of each label that are learned from, at most; n-grams that are kept.
SAMPLE, KEPT = 2000, 4000
LEARNING_TASKS = 32
THRESHOLD = 0.7
_PART = 1 << 14


def present(text: str | None) -> np.ndarray:
    """Buckets of the n-grams in a text, each once."""
    h = ngrams(letters(text), SIZES, BITS)
    mark = np.zeros(1 << BITS, bool)
    mark[h] = True
    return np.flatnonzero(mark) if len(h) > 20_000 else np.unique(h)


def _ratios(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-count ratios and how telling each n-gram is."""
    p, q = (toxic + 0.5) / (n_toxic + 1), (other + 0.5) / (n_other + 1)
    ratio = np.log(p / q)
    return ratio, np.abs(p - q) / np.sqrt((p + q) / 2 * (1 / max(1, n_toxic) + 1 / max(1, n_other)))


def logistic(rows: list[np.ndarray], y: np.ndarray, size: int, scale: np.ndarray, steps: int = 300, reg: float = 3e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on binary rows times scale; labels weigh alike."""
    at = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(owner, weights=(w * scale)[at], minlength=len(rows)) + b
        e = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g, gb = np.bincount(at, weights=e[owner], minlength=size) * scale + reg * w, e.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.05 / (1 - 0.9**t)
        w -= rate * m / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= rate * mb / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, b


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, kept: int = KEPT) -> dict:
    """The model from labelled rows that are not held out.

    docs: doc_id and text; labels: doc_id and toxic. At most sample labels of each kind are learned from, by a hash of the id;
    labels that repeat count once, a document with both labels is in both. Null
    texts and labels are left out; with only one label the score is that label's share."""
    rows = labels.select("doc_id", "toxic").filter(~held_out() & F.col("toxic").isin(0, 1))
    chosen = bounded_sample(rows, "toxic", ["doc_id"], sample)  # bounded, so it may be broadcast
    texts = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # one text an id, so it stays bounded
    texts = texts.select("text", "toxic").repartition(LEARNING_TASKS)

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((2, 1 << BITS), np.int64)
        n = [0, 0]
        for pdf in batches:
            for text, y in zip(pdf["text"], pdf["toxic"]):
                seen[int(y), present(text)] += 1
                n[int(y)] += 1
        if sum(n):
            for k in range(0, 1 << BITS, _PART):
                yield pd.DataFrame({"k": [k], "n0": [n[0]], "n1": [n[1]], "c": [seen[:, k : k + _PART].astype(np.int32).tobytes()]})

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.int32).astype(np.int64) for c in pdf["c"])
        return pd.DataFrame({"k": pdf["k"][:1], "n0": [pdf["n0"].sum()], "n1": [pdf["n1"].sum()], "c": [total.astype(np.int32).tobytes()]})

    schema = "k long, n0 long, n1 long, c binary"
    parts = sorted(map_rows(texts, counts, schema).groupBy("k").applyInPandas(summed, schema).collect())
    if not parts:
        return {"table": np.zeros(1 << BITS, np.float32), "bias": 0.0}
    n_other, n_toxic = parts[0]["n0"], parts[0]["n1"]
    if not n_other or not n_toxic:
        return {"table": np.zeros(1 << BITS, np.float32), "bias": 30.0 if n_toxic else -30.0}
    both = np.concatenate([np.frombuffer(p["c"], np.int32).reshape(2, -1) for p in parts], axis=1)
    ratio, telling = _ratios(both[1], both[0], n_toxic, n_other)
    best = np.sort(np.argsort(-telling, kind="stable")[:kept])
    shared = docs.sparkSession.sparkContext.broadcast(best)

    def chosen_only(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = [np.flatnonzero(np.isin(shared.value, present(t), assume_unique=True)).astype(np.int32).tobytes() for t in pdf["text"]]
            yield pd.DataFrame({"toxic": pdf["toxic"].astype("int64"), "x": x})

    got = sorted((r["toxic"], bytes(r["x"])) for r in map_rows(texts, chosen_only, "toxic long, x binary").toLocalIterator())
    y = np.array([g[0] for g in got], np.float64)
    w, b = logistic([np.frombuffer(g[1], np.int32) for g in got], y, len(best), ratio[best])
    table = np.zeros(1 << BITS, np.float32)
    table[best] = (w * ratio[best]).astype(np.float32)
    return {"table": table, "bias": float(b)}


def score_one(model: dict, text: str | None) -> float:
    z = float(model["table"][present(text)].sum()) + model["bias"]
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score (0 to 1, higher: more likely toxic), predicted of every row of docs; null counts as empty.

    predicted is 1 from a score of exactly THRESHOLD on. Repeated rows score alike; other columns are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": [score_one(shared.value, t) for t in pdf["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = map_rows(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
