"""Spelling variants, byte-pair encoding and ranked search against brute force and the library."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from codonweave.llm import balltree, bpe, spelling

DOCS = "doc_id long, text string, word string, n string, form int, item_id string, score string, ids string"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "w", "n", 1, "q", "s", "x") for i, t in rows], DOCS)


def brute_variants(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    letters = sorted({c for w in words for c in w})

    def near(w):
        found = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        return {x for x in found | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters} if x in words} - {w}

    near_of = {w: near(w) for w in words}
    form = {}
    for w, ns in near_of.items():
        if ns and words[top := min(ns, key=lambda x: (-words[x], x))] >= 10 * words[w]:
            form[w] = top

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(near_of[w]), words.get(form.get(w))) for w, n in words.items()}


def drawn_words(seed):
    """Texts of words whose variants stand in chains of tenfold counts, with ties, repeated letters and letters beyond ASCII."""
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abeoßàÿÀ×z") for _ in range(rng.randrange(7, 12))) for _ in range(40)] + ["aaaaaaaa", "aaaaaaab", "q" * 70, "q" * 69, "q" * 69 + "z"]
    text = []
    for b in bases:
        text += [b] * rng.choice([2, 20, 240])
        for _ in range(5):
            i, c = rng.randrange(len(b)), rng.choice("abeoÿÀz")
            text += [rng.choice([b[:i] + b[i + 1 :], b[:i] + c + b[i:], b[:i] + c + b[i + 1 :]])] * rng.choice([1, 2, 3, 24])
    rng.shuffle(text)
    return [(k, " ".join(w.upper() if w.isascii() and rng.random() < 0.3 else w for w in text[k::60])) for k in range(60)]


def test_variants_against_brute_force(spark):
    rows = [*drawn_words(1), (None, "Ordinary ordinary ordinary1ordinary"), (None, "ordinary"), (7, None), (8, ""), (9, "12 345"), *drawn_words(1)[:5]]
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(docs_of(spark, rows).repartition(3)).collect()}
    want = brute_variants(rows)
    assert got == want
    assert len({w for w in want if want[w][0]}) > 20 and any(want[w][1] != want[w][0] for w in want if want[w][0])
    assert spelling.variants(docs_of(spark, rows).filter("doc_id < 0")).count() == 0


@pytest.mark.parametrize("most", [40, 200, 1 << 20])
def test_pairs_do_not_depend_on_the_filters(spark, most):
    """Filters over the bound are made in passes by length, and by hash within a length."""
    counts = {w: n for w, (_, _, n, _, _) in brute_variants(drawn_words(2)).items()}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = Counter(tuple(sorted((r["word"], r["other"]))) for r in spelling.near_pairs(words, most).collect())
    want = brute_variants(drawn_words(2))
    assert sum(x[3] for x in want.values()) == 2 * len(got) and set(got.values()) == {1}
    for a, b in got:
        assert abs(len(a) - len(b)) <= 1


def test_filters_have_no_false_negatives_and_few_false_positives():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(20_000)]
    f = spelling.Filters({9: 20_000})
    block, bits = f.place(spelling.hashes(spelling._codes(words[:10_000] * 2)), 9)
    filled = np.zeros(f.size, np.uint64)
    np.bitwise_or.at(filled, block, bits)
    block, bits = f.place(spelling.hashes(spelling._codes(words)), 9)
    hit = filled[block] & bits == bits
    assert hit[:10_000].all() and hit[10_000:].mean() < 0.02


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary())


ODD = [None, "", " \n\t ", "it's we'll THEY'RE", "x" * 3000, "ab" * 900, "Σίσυφος ΣΑΣ ẞ İi", "a<|endoftext|>b <|startoftext|><|endoftext|>", "é é ́a", "naïve—“quotes” 東京 🙂", "1234 5", "a" * 64, "a" * 65, "same", "same"]


def drawn_texts(n):
    rng = random.Random(11)
    pool = [*"aAbeEzZéÉßΣςıñ 0189'\"!?.,-—„東́ \t\n\r\x0b\x85<|>🙂ﬁ", "<|endoftext|>", "'s", "'LL", "the", "ing"]
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_bpe_against_the_library(spark, library):
    rows = list(enumerate([*ODD, *drawn_texts(600)]))
    df = docs_of(spark, rows)
    wanted = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    encoded = bpe.encode(df)
    ids = {r["doc_id"]: (r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) for r in encoded.collect()}
    assert ids == {i: (len(x), x) for i, x in wanted.items()}
    back = {i: library.decode(x, skip_special_tokens=False) for i, x in wanted.items()}
    assert {r["doc_id"]: r["text"] for r in bpe.decode(encoded).collect()} == back
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r["doc_id"]: (r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(df).collect()}
    assert got == {i: (sha(np.array(x, "<u4").tobytes()), sha(back[i].encode())) for i, x in wanted.items()}
    assert bpe.digests(df.filter("doc_id < 0")).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary")).first()["text"] == ""


def test_trees_alone_and_together_merge_alike():
    t = bpe.tables(bpe.vocabulary())
    rng = random.Random(12)
    words = [bytes(rng.choice(b"aeinrst\xc3\xa9") for _ in range(rng.randrange(1, 65))) for _ in range(500)] + [b"\x00", b"\xff\xfe", b"hello", b"aaaa"]
    words = sorted(words, key=len)
    assert [np.frombuffer(x, "<u4").tolist() for x in t.merge_many(words)] == [t.merge_one(w) for w in words]


def brute_ranks(docs, items, top=50):
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    own = [(d, Counter(terms(t))) for d, t in docs]
    own = [(d, c) for d, c in own if c]
    many, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in own:
            m = 50 + 50 * sum(c.values()) * many // total
            s = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=str)


def drawn_search(n, seed):
    rng = random.Random(seed)
    pool = [f"T{rng.randrange(10**6)}é" if k % 5 else f"w_{k}" for k in range(300)]
    pick = lambda m: " ".join(pool[min(299, int(rng.expovariate(1 / 40)))] for _ in range(m))
    docs = [(k, pick(rng.randrange(1, 80))) for k in range(n)]
    docs += [(n + k, docs[k % 7][1]) for k in range(60)] + [(3, docs[3][1]), (None, docs[0][1]), (n + 90, None), (n + 91, ""), (n + 92, "-- !"), (n + 93, "w " * 3000)]
    return docs, [(k, pick(12)) for k in range(12)] + [(2, docs[5][1]), (20, None), (21, ""), (22, "none_of_these"), (23, pool[0])]


@pytest.mark.parametrize("floor_rows", [50_000, 40])
def test_search_against_brute_force(spark, floor_rows):
    docs, items = drawn_search(500, 5)
    df, asked = docs_of(spark, docs).repartition(3), spark.createDataFrame([(i, t, "d") for i, t in items], "item_id long, text string, doc_id string")
    got = sorted((tuple(r) for r in balltree.ranked(df, asked, floor_rows=floor_rows).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == brute_ranks(docs, items)
    assert balltree.ranked(df.filter("doc_id < 0"), asked).count() == 0 and balltree.ranked(df, asked.filter("item_id < 0")).count() == 0


def test_trees_leave_out_nothing(monkeypatch):
    """Many blocks, shared radii and small leaves; a tree's bounds are over each score beneath them."""
    monkeypatch.setattr(balltree, "GROUPS", 24)
    monkeypatch.setattr(balltree, "BLOCK_TERMS", 40)
    rng = np.random.default_rng(6)
    weight, df = rng.integers(0, 9000, 90), rng.integers(1, 50, 90)
    items = [(k, sorted(rng.choice(90, 8, replace=False).tolist())) for k in range(20)]
    rows = [np.sort(rng.choice(90, rng.integers(1, 12), replace=False)) for _ in range(400)]
    values = [rng.integers(1, 10**6, len(r)) for r in rows]
    blocks = balltree.blocks_of(items, weight, df)
    assert len(blocks) > 2
    best = {k: balltree.Best(10, 1) for k, _ in items}
    scored = 0
    for block in blocks:
        held = [np.isin(r, block.terms) for r in rows]
        there = [i for i, h in enumerate(held) if h.any()]
        term = np.searchsorted(block.terms, np.concatenate([rows[i][held[i]] for i in there]))
        tree = balltree.Tree(term, np.concatenate([values[i][held[i]] for i in there]), np.array([held[i].sum() for i in there]), block)
        for at, w, group, length in block.of.values():
            dense = np.zeros(len(block.terms), np.int64)
            dense[at] = w
            for (lo, hi), bound in zip(tree.spans, tree.bounds(at, w, group, length)):
                assert tree.scores(lo, hi, dense).max() <= bound
        scored += balltree.search(tree, block, best, there)
    assert scored < 0.9 * sum(len(b.of) for b in blocks) * len(rows)
    for k, terms in items:
        scores = [(-sum(int(weight[t]) * int(v) for t, v in zip(r, vs) if t in terms), i) for i, (r, vs) in enumerate(zip(rows, values))]
        best[k].cut()
        assert [(s, i) for s, _, i in best[k].held] == [x for x in sorted(scores) if x[0] < 0][:10]


def test_long_items_and_many_blocks():
    items = [(0, list(range(9000))), (1, [1, 2]), (2, [3])]
    found = balltree.blocks_of(items, np.ones(9000, np.int64), np.ones(9000, np.int64))
    assert [list(b.of) for b in found] == [[0], [1, 2]] and found[0].groups == balltree.GROUPS


def test_written_tables_that_nothing_reads_are_gone(spark):
    """What is left in the shared folder is what the lazy results still read."""
    from codonweave.llm import near

    rng = random.Random(31)
    base = [f"w{rng.randrange(4000)}" for _ in range(60)]
    texts = [" ".join(base[: 40 + k % 9] + [f"x{k % 4}"]) for k in range(30)] + [" ".join(f"w{rng.randrange(4000)}" for _ in range(30)) for _ in range(10)]
    df = docs_of(spark, list(enumerate(texts)))
    items = spark.createDataFrame([(1, texts[0]), (2, "w1 w2 w3")], "item_id long, text string")
    folder, left = Path(spark.conf.get("spark.checkpoint.dir")), {}
    for name, job in (("near", lambda: near.near_groups(df)), ("drop", lambda: near.drop_near(df)), ("words", lambda: spelling.variants(df)), ("search", lambda: balltree.ranked(df, items))):
        before = set(folder.iterdir()) if folder.exists() else set()
        out = job()
        left[name] = len(set(folder.iterdir()) - before)
        out.collect()
    assert left["near"] <= 2 and left["drop"] <= 3 and left["words"] <= 2 and left["search"] <= 1, left
