"""Language identification in two steps: the family, then one-versus-one linear SVMs inside it.

Features are the square roots of hashed character n-gram frequencies of the whole text, which have length one."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonweave.llm.classify import bounded_sample, held_out, letters, ngrams
from codonweave.llm.common import map_rows

SIZES, BITS = (1, 2, 3), 12
#: Texts of a language that are learned from, at most.
SAMPLE = 800
UNKNOWN = "und"

# Language families by ISO 639-1 code. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "indic": "hi bn pa gu mr ne ur",
    "turkic": "tr az kk uz",
    "semitic": "ar he mt am",
}


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.split("-")[0].lower() in codes.split()), lang)


def features(text: str | None) -> np.ndarray:
    h = ngrams(letters(text), SIZES, BITS)
    x = np.sqrt(np.bincount(h, minlength=1 << BITS).astype(np.float32) / max(1, len(h)))
    return x / max(1e-9, float(np.sqrt((x * x).sum())))


def linear_svm(x: np.ndarray, y: np.ndarray, rounds: int = 30, reg: float = 1e-4, seed: int = 7) -> np.ndarray:
    """Weights (bias last) of a linear SVM by subgradient steps on the hinge loss; y is -1 or 1, classes weigh alike."""
    rng = np.random.default_rng(seed)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    w, mean, t = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float64), 0
    for k in range(rounds):
        for batch in np.array_split(rng.permutation(len(x)), max(1, len(x) // 32)):
            t += 1
            short = y[batch] * (x[batch] @ w) < 1
            g = (weight[batch] * y[batch] * short) @ x[batch] / len(batch)
            w = w * (1 - reg) + (4 / np.sqrt(1 + t / 20)) * g.astype(np.float32)
            if k >= rounds // 2:
                mean += w
    return (mean / max(1, np.abs(mean).max()) if not t else mean / max(1, t - t * (rounds // 2) // rounds)).astype(np.float32)


def _ones(x: np.ndarray, names: list[str]) -> dict:
    """One SVM for each pair of names."""
    got = sorted(set(names))
    names = np.array(names)
    out = {}
    for a, b in itertools.combinations(got, 2):
        own = (names == a) | (names == b)
        out[a, b] = linear_svm(x[own], np.where(names[own] == a, 1.0, -1.0))
    return {"names": got, "pairs": out}


def _choose(model: dict, x: np.ndarray) -> tuple[str, float]:
    """The name that wins most pairs, of equals that of the greater sum of margins, then the last in the alphabet; and how sure that is."""
    names = model["names"]
    if len(names) == 1:
        return names[0], 1.0
    votes = {n: [0, 0.0, np.inf] for n in names}
    for (a, b), w in model["pairs"].items():
        margin = float(x @ w[:-1] + w[-1])
        for n, m in ((a, margin), (b, -margin)):
            votes[n] = [votes[n][0] + (m > 0), votes[n][1] + m, min(votes[n][2], m)]
    name = max(names, key=lambda n: (votes[n][0], votes[n][1], n))
    return name, float(1 / (1 + np.exp(-2 * np.clip(votes[name][2], -20, 20))))


def train(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """The two-step model from the rows of docs (doc_id, text, lang) that are not held out.

    At most sample texts of each language are learned from, by a hash of id and text; repeated rows count once. Texts that are
    null or have no letter are left out."""
    rows = docs.select("doc_id", "text", "lang").filter(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    chosen = bounded_sample(rows, "lang", ["doc_id", "text"], sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"lang": pdf["lang"], "x": [features(t).tobytes() for t in pdf["text"]]})

    got = sorted((r["lang"], bytes(r["x"])) for r in map_rows(chosen, run, "lang string, x binary").toLocalIterator())
    if not got:
        return {"family": None, "langs": {}}
    langs = [g[0] for g in got]
    x = np.frombuffer(b"".join(g[1] for g in got), dtype=np.float32).reshape(len(got), -1)
    kin = [family(n) for n in langs]
    inside = {f: _ones(x[[k == f for k in kin]], [n for n, k in zip(langs, kin) if k == f]) for f in set(kin)}
    return {"family": _ones(x, kin), "langs": inside}


def predict_one(model: dict, text: str | None) -> tuple[str, float]:
    if model["family"] is None or not text or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0
    x = features(text)
    kin, sure = _choose(model["family"], x)
    lang, more = _choose(model["langs"][kin], x)
    return lang, sure * more


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs; 'und' and 0 for null texts and texts without a letter.

    A letter is a character of the Unicode categories L. Without any learned language all texts are 'und'. Only the text of
    a row decides, so repeated rows are predicted alike; other columns are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame([predict_one(shared.value, t) for t in pdf["text"]], columns=["lang_pred", "score"])
            out.insert(0, "doc_id", pdf["doc_id"])
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double")
