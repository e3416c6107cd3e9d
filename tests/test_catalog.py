"""Every query with SQL gives the rows that DuckDB gives on the smallest tables; the others are checked by what holds for them."""

from __future__ import annotations

import glob
import math
import os
import re

import duckdb
import pandas as pd
import pytest

from codonweave.operators import splice
from codonweave.plans import catalog


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("float"):
            df[c] = df[c].map(lambda v: "null" if v != v else f"{v:.6f}")
        else:
            df[c] = df[c].map(lambda v: "null" if v is None or v is pd.NA or v != v else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    got = normal(catalog.queries()[name](spark, sf_dir).toPandas())
    want = normal(duck.sql(catalog.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want)


def test_queries_without_sql(spark, sf_dir):
    """Hash samples and fitted scorers; their classes need more rows than the smallest tables have."""
    larger = sf_dir.replace("sf0.001", "sf0.01")
    found = catalog.queries()
    assert set(found) - set(catalog.oracle_sql()) == {"stratified_sample", "rbf_scores", "candidate_regions"}
    assert {r["count"] for r in found["stratified_sample"](spark, larger).groupBy("reg_type").count().collect()} == {500}
    scores = found["rbf_scores"](spark, larger)
    assert scores.count() == spark.read.parquet(f"{larger}/lineitem.parquet").count() and scores.filter("svm_score is null").isEmpty()
    ranked = found["candidate_regions"](spark, larger)
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, ranked.count() + 1))


def _dna(sf_dir):
    texts = pd.read_parquet(f"{sf_dir}/documents.parquet").dropna(subset=["text"])
    return {i: re.sub("[^ACGT]", "", t.upper()) for i, t in zip(texts["doc_id"], texts["text"])}


def _index(w):
    return sum("ACGT".index(c) * 4 ** (len(w) - 1 - i) for i, c in enumerate(w))


def _coef(i):
    return ((i * 7919 + 13) % 99991 + 1) / 99991


def _donor(w):
    return math.log2(splice.DONOR_FACTOR * _coef(_index(w)))


def _acceptor(w):
    x = [_coef(_index(w[a : b + 1]) + sum(splice.SIZES[:k])) for k, (a, b) in enumerate([*splice.TIMES, *splice.DIVIDE])]
    return math.log2(splice.ACCEPTOR_FACTOR * math.prod(x[:5]) / math.prod(x[5:]))


@pytest.mark.parametrize("name, k, value", [("kmer_index_windows", 7, _index), ("donor_window_scores", 7, _donor), ("acceptor_window_scores", 21, _acceptor)])
def test_every_window(spark, sf_dir, name, k, value):
    got = catalog.queries()[name](spark, sf_dir).toPandas()
    dna = _dna(sf_dir)
    want = {(i, p + 1): s[p : p + k] for i, s in dna.items() for p in range(len(s) - k + 1)}
    doc, pos, text, x = (got[c] for c in got.columns)
    assert len(got) == len(want) and dict(zip(zip(doc, pos), text)) == want
    assert max(len(s) for s in dna.values()) > 600  # more than one stretch
    assert x.to_numpy() == pytest.approx([value(w) for w in text], abs=1e-5)
