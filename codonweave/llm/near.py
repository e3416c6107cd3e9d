"""N-gram Jaccard self-join with adaptive multi-match prefixes, and the groups its links make.

A document is the set of its 5-word shingles in hash order. p = n - ceil(0.75 n) + 1 tokens are a
prefix of which linked documents share one; of prefixes longer by l - 1 they share l. Each document
lengthens its prefix by what its tokens would cost in candidates: one token for each frequent token
in it, and one for each candidate that its other tokens would bring. A document whose frequent
tokens fit into the lengthened part (kind A) is then matched on its rare tokens alone: at least one of the
l shared tokens is rare, and as many more as rare tokens were added. Kind A stops lengthening
where the smallest linkable partner would have to stop, so the shorter of two prefixes always decides and
a pair with one of kind A is never missed. Documents with more frequent tokens (kind B: mostly copies) are joined
with each other once more, on whole sets ordered by how many of them hold a token, rarest first.

Equal sets are one class from the start. Classes that share tokens are first verified against one
pivot each and components are formed; only tokens whose classes lie in different components are
then joined pair by pair, so a group of copies never yields all its pairs. Copies x, y with one pivot c
overlap in at most min(|x & c|, |y & c|) tokens of c, which are known, so what is lacking must be tokens
outside c: copies are joined on those, and on their prefixes only where nothing is lacking. Both bounds are exact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codonweave.llm.common import connected_components, mix, parts_of, shingle_sets
from codonweave.session import discard, materialize, scratch, ship

#: A token in more classes than this is frequent.
FREQUENT = 20
#: Document ids that may be broadcast when their texts are fetched (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 100_000
STAR_ROUNDS = 2
#: A token that more than one in so many rows hold is counted apart.
USUAL = 64
#: Tasks over which the tokens of one pivot are dealt.
SALTS = 64


def needed(n):
    """Least overlap of a set of n with any linked set."""
    return (3 * n + 3) // 4


def room(n):
    """Tokens by which a prefix of a set of n may be lengthened."""
    return np.minimum(n // 10 + 8, n - (n - needed(n) + 1))


def _needed(n: Column) -> Column:
    return F.floor((3 * n + 3) / 4)


def _room(n: Column) -> Column:
    return F.least(F.floor(n / 10) + 8, _needed(n) - 1)


def _fingerprint(s: np.ndarray) -> int:
    return int(mix(mix(s.view(np.uint64)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s))).view(np.int64)[0])


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and th, a hash of the text: rows that agree on doc_id and th are one document."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, th, n (set size), fp (64-bit fingerprint of the set), head (the longest prefix) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            sets = shingle_sets(batch.column("text"))
            heads = [s[: len(s) - needed(len(s)) + 1 + room(len(s))] if len(s) else s for s in sets]
            fps = pa.array([_fingerprint(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array([len(s) for s in sets], pa.int64()), fps, _lists(heads)], names=["doc_id", "th", "n", "fp", "head"])

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _texts(docs).mapInArrow(run, f"doc_id {kind}, th long, n long, fp long, head array<long>")


def _lists(sets: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([*sets, np.empty(0, np.int64)])))


def _meet(a: DataFrame, b: DataFrame, how: str, n: int, th: str = "th") -> DataFrame:
    """Rows of a with the documents (doc_id, th) of b; null ids are equal. n: rows of b, which is broadcast if they are few.

    th: a's column of text hashes."""
    same = a["doc_id"].eqNullSafe(b["doc_id"]) & a[th].eqNullSafe(b["th"])
    return a.join(F.broadcast(b) if n <= BROADCAST_IDS else b, same, how)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, items): whole sets of the classes in wanted (fp, rep: doc_id and th of one of its rows). Repeated rows bring a set twice."""
    few = wanted.select("fp", "rep.doc_id", "rep.th")
    texts = _meet(_texts(docs), few, "inner", few.count()).select("fp", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            yield pa.RecordBatch.from_arrays([batch.column("fp"), _lists(shingle_sets(batch.column("text")))], names=["fp", "items"])

    ship(docs.sparkSession)
    return texts.mapInArrow(run, "fp long, items array<long>")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) with common, the size of their sets' overlap, and linked: whether their Jaccard similarity is 0.75 or more."""
    pairs = materialize(pairs.select("a", "b").distinct())
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(classes.select("fp", "rep"), "fp"))
    sets = materialize(_sets(docs, wanted).dropDuplicates(["fp"]))
    x = pairs.join(sets.select(F.col("fp").alias("a"), F.col("items").alias("x")), "a")
    both = x.join(sets.select(F.col("fp").alias("b"), F.col("items").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            sets = [(x.values.to_numpy(), y.values.to_numpy()) for x, y in zip(batch.column("x"), batch.column("y"))]
            common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in sets], np.int64)
            total = np.array([len(x) + len(y) for x, y in sets], np.int64)
            columns = [batch.column("a"), batch.column("b"), pa.array(common), pa.array(100 * common >= 75 * (total - common))]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "common", "linked"])

    ship(docs.sparkSession)
    done = materialize(both.mapInArrow(run, "a long, b long, common long, linked boolean"))
    discard(pairs, wanted, sets)
    return done


def _close(n: str, m: str) -> Column:
    """Set sizes that a link allows."""
    return (4 * F.least(n, m) >= 3 * F.greatest(n, m))


def usual_tokens(sets: DataFrame, items: str) -> DataFrame:
    """(token): every token that more than one in USUAL rows of sets holds, and few others.

    Each task keeps a Misra-Gries summary, which undercounts a token by its rows' items over the counters at most; with USUAL
    times two times the mean items of a row in counters, a token that is kept is in at least one of 2 * USUAL rows, so there
    are at most 2 * USUAL times the mean items of a row, however many rows there are."""
    rows, total = sets.agg(F.count("*"), F.sum(F.size(items))).first()
    if not total:
        return sets.sparkSession.createDataFrame([], "token long")
    counters = 2 * USUAL * -(-total // rows)

    def merged(token: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(token, kind="stable")
        token, n = token[order], n[order]
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        token, n = token[first], np.add.reduceat(n, first)
        if len(n) > counters:
            n = n - np.partition(n, len(n) - counters - 1)[len(n) - counters - 1]
            token, n = token[n > 0], n[n > 0]
        return token, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, n = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            own = np.sort(batch.column(0).flatten().to_numpy())
            if len(own):
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                token, n = merged(np.append(token, own[first]), np.append(n, np.diff(np.append(first, len(own)))))
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n)], names=["token", "c"])

    ship(sets.sparkSession)
    found = sets.select(items).mapInArrow(run, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))
    return found.filter(F.col("c") >= rows / USUAL - total / counters).select("token")


def with_df(tokens: DataFrame, usual: DataFrame) -> DataFrame:
    """tokens with df, how many of its rows hold the token; tokens of one row are left out.

    The usual ones are counted within each task first, and stay where they are; only the others are laid together by token."""
    usual = materialize(usual)
    if usual.isEmpty():
        discard(usual)
        return tokens.withColumn("df", F.count("*").over(W.partitionBy("token"))).filter("df > 1")
    counts = materialize(tokens.join(F.broadcast(usual), "token").groupBy("token").agg(F.count("*").alias("df")))
    warm = tokens.join(F.broadcast(counts), "token")
    cold = tokens.join(F.broadcast(counts.select("token")), "token", "left_anti").withColumn("df", F.count("*").over(W.partitionBy("token")))
    return cold.unionByName(warm).filter("df > 1")


def prefixes(tokens: DataFrame) -> DataFrame:
    """(token, df, fp, n, pos) of shared tokens to the rare tokens of each class's adaptive prefix.

    Adds kind ('A' or 'B'), l (the prefix is longer by l - 1) and m (rare tokens to share)."""
    frequent = F.col("df") > FREQUENT
    p = F.col("n") - _needed(F.col("n")) + 1
    per = tokens.groupBy("fp", "n").agg(
        F.array_sort(F.collect_list(F.when(frequent, F.col("pos")))).alias("at"),
        F.sum(F.when(~frequent & (F.col("pos") < p), F.col("df") - 1).otherwise(0)).alias("cost"),
    )
    limit = 1 + _room(_needed(F.col("n")))  # where the smallest partner stops

    def lengthened(start: Column) -> Column:
        return F.aggregate("at", start, lambda l, q: F.when(q < p + l - 1, l + 1).otherwise(l))

    per = per.withColumn("least_l", lengthened(F.lit(1).cast("long"))).withColumn("kind", F.when(F.col("least_l") <= limit, "A").otherwise("B"))
    per = per.withColumn("extra", F.least(F.col("cost"), F.greatest(limit - F.col("least_l"), F.lit(0))))
    # more matches than one, as many as the candidates expected or as the longest prefix allows
    per = per.withColumn("more_l", lengthened(1 + F.col("extra"))).withColumn("fits", F.col("more_l") <= limit)
    longest_m = limit - F.size(F.filter("at", lambda q: q < p + limit - 1))
    per = per.select(
        "fp", "kind",
        F.when(F.col("kind") == "B", 1 + _room(F.col("n"))).when(F.col("fits"), F.col("more_l")).otherwise(limit).cast("long").alias("l"),
        F.when(F.col("kind") == "B", 1).when(F.col("fits"), 1 + F.col("extra")).otherwise(longest_m).cast("long").alias("m"),
    )
    rows = tokens.join(per, "fp").withColumn("frequent", frequent)
    return rows.filter((F.col("pos") < p + F.col("l") - 1)).select("token", "fp", "n", "kind", "l", "m", "frequent")


def whole_tokens(sets: DataFrame) -> DataFrame:
    """Whole sets (fp, items) to (token, fp, n, own, usual, pos) of tokens that several hold.

    own: how many such tokens a class has; classes with fewer than any link needs are left out. pos: the token's
    place in its class, rarest first, from 1, tokens of one class before all. usual: how many classes its tokens have on average."""
    tokens = sets.select("fp", F.size("items").cast("long").alias("n"), F.explode("items").alias("token"))
    tokens = with_df(tokens, usual_tokens(sets, "items"))
    per = tokens.withColumn("own", F.count("*").over(W.partitionBy("fp"))).filter(F.col("own") >= _needed(F.col("n")))
    place = F.col("n") - F.col("own") + F.row_number().over(W.partitionBy("fp").orderBy("df", "token"))
    usual = F.sum("df").over(W.partitionBy("fp")) / F.col("n")
    return per.select("token", "fp", "n", "own", usual.alias("usual"), place.alias("pos"))


def _star(rows: DataFrame, by: Column) -> DataFrame:
    """Candidates (a, b): each class b with the pivot a of most of its tokens. A token's pivot is least in `by`."""
    least = rows.groupBy("again", "token").agg(F.min(F.struct(by.alias("by"), F.col("fp"), F.col("n"))).alias("pivot"), F.count("*").alias("c")).filter("c > 1")
    pairs = rows.join(least, ["again", "token"]).filter("fp <> pivot.fp").filter(_close("n", "pivot.n"))
    votes = pairs.groupBy("again", F.col("pivot.fp").alias("a"), F.col("fp").alias("b"), "m").agg(F.count("*").alias("votes")).filter("4 * votes >= m")
    return votes.groupBy("again", "b").agg(F.max(F.struct("votes", "a")).alias("best")).select("best.a", "b")


def _overlap(n: str, m: str) -> Column:
    """Least overlap of two linked sets of these sizes: 100 c >= 75 (n + m - c)."""
    return F.floor((75 * (F.col(n) + F.col(m)) + 174) / 175)


def _rest(rows: DataFrame) -> DataFrame:
    """Candidates (a, b) of different components that share as many prefix tokens as a link needs. rows has comp."""
    rows = _split(rows)
    names = ("fp", "n", "comp", "kind", "m", "own", "pivot", "held")
    other = rows.select("again", "token", *[F.col(c).alias(f"{c}2") for c in names])
    least = _overlap("n", "n2")
    of_one = F.col("again") & (F.least("own", "own2") >= least) & ((F.col("pivot") != F.col("pivot2")) | (F.least("held", "held2") >= least))
    fits = of_one | (~F.col("again") & ((F.col("kind") == "A") | (F.col("kind2") == "A")))
    pairs = rows.join(other, ["again", "token"]).filter("fp < fp2 and comp <> comp2").filter(_close("n", "n2") & fits)
    # between kinds A and B the prefix of A decides
    need = F.when(F.col("kind") == F.col("kind2"), F.least("m", "m2")).when(F.col("kind") == "A", F.col("m")).otherwise(F.col("m2"))
    return pairs.groupBy("again", F.col("fp").alias("a"), F.col("fp2").alias("b"), need.alias("need")).agg(F.count("*").alias("shared")).filter("shared >= need").select("a", "b")


def _outside(tokens: DataFrame) -> DataFrame:
    """Candidates (a, b) of one pivot and different components that share enough tokens outside it.

    tokens: (token, fp, n, own, pivot, held, comp)."""
    mixed = tokens.groupBy("pivot").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("pivot")
    # the tokens of a pivot that many classes share are dealt over SALTS tasks
    keys = ["pivot", "salt"]
    salt = F.pmod("token", F.lit(SALTS))
    own = tokens.withColumn("salt", salt).join(mixed.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")), keys)
    of_pivot = tokens.select(F.col("fp").alias("pivot"), "token").join(mixed, "pivot", "left_semi").withColumn("salt", salt)
    out = own.filter("fp <> pivot").join(of_pivot, [*keys, "token"], "left_anti")
    other = out.select(*keys, "token", *[F.col(c).alias(f"{c}2") for c in ("fp", "n", "comp", "held")])
    pairs = out.join(other, [*keys, "token"]).filter("fp < fp2 and comp <> comp2").filter(_close("n", "n2"))
    lack = _overlap("n", "n2") - F.least("held", "held2")
    return pairs.groupBy(F.col("fp").alias("a"), F.col("fp2").alias("b"), lack.alias("lack")).agg(F.count("*").alias("shared")).filter("shared >= lack").select("a", "b")


def _split(rows: DataFrame) -> DataFrame:
    """The rows of tokens whose classes lie in several components."""
    split = rows.groupBy("again", "token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("again", "token")
    return rows.join(split, ["again", "token"])


def _joined(links: DataFrame) -> DataFrame:
    """(node, component) of the links, written; what the rounds wrote is gone."""
    with scratch() as keep:
        return keep(materialize(connected_components(links)))


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, th, n, fp) of docs, and (fp, component, component_id, chosen, members) of the classes in groups of several rows.

    chosen: the document (doc_id, th) of the least doc_id that is not null, if there is one, and of its texts that of the least hash."""
    heads = materialize(signatures(docs))
    sig = materialize(heads.drop("head"))
    document = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    classes = materialize(sig.filter("n > 0").groupBy("fp").agg(F.min(document).alias("rep"), F.min("n").alias("n"), F.count("*").alias("copies")))
    # one row per class: where a class has copies, only the first document stays, and repeated rows of it are told by pos alone
    repeated = classes.filter("copies > 1").select("fp", "rep")
    single = heads.filter("n > 0").select("fp", document.alias("document"), "n", "head")
    few = repeated.count() <= BROADCAST_IDS
    marked = single.join(F.broadcast(repeated) if few else repeated, "fp", "left")
    ones = marked.filter("rep is null or rep <=> document").select("fp", "n", "head")
    tokens = ones.select("fp", "n", F.posexplode("head").alias("pos", "token"))
    with scratch() as keep:
        tokens = with_df(tokens, usual_tokens(heads.select("head"), "head"))
        tokens = keep(materialize(tokens.select("token", "df", "fp", "n", F.col("pos").cast("long").alias("pos")).distinct()))
    discard(heads)
    first = materialize(prefixes(tokens))
    discard(tokens)
    copies = materialize(first.filter("kind = 'B'").select("fp").distinct().join(classes.select("fp", "rep"), "fp"))
    sets = materialize(_sets(docs, copies).dropDuplicates(["fp"]))
    with scratch() as keep:
        whole = keep(materialize(whole_tokens(sets)))
    discard(sets, copies)
    prefix = whole.filter(F.col("pos") <= F.col("n") - _needed(F.col("n")) + 1)
    again = prefix.select("token", "fp", "n", F.lit("B").alias("kind"), F.lit(1).cast("long").alias("m"), F.lit(True).alias("again"), "own")
    rows = first.filter("not frequent").select("token", "fp", "n", "kind", "m", F.lit(False).alias("again"), F.col("n").alias("own")).unionByName(again)
    rows = materialize(rows)
    discard(first)

    # copies look for a pivot by all their tokens, and the most usual of them are pivots: edits are rare, the original is usual
    stars = rows.filter("not again").select("again", "token", "fp", "n", "m", F.col("fp").cast("double").alias("by"))
    stars = stars.unionByName(whole.select(F.lit(True).alias("again"), "token", "fp", "n", F.lit(1).cast("long").alias("m"), (-F.col("usual")).alias("by")))
    verified = [_verified(docs, classes, _star(stars, F.col("by")))]
    checked = verified[0]
    for k in range(1, STAR_ROUNDS):  # only tokens that hold several components need another pivot
        joined = _joined(checked.filter("linked"))
        verified.append(_verified(docs, classes, _star(_split(_with_component(stars, joined)), F.xxhash64("fp", F.lit(k)))))
        checked = checked.unionAll(verified[-1])
        discard(joined)
    links = checked.filter("linked").select("a", "b")
    comp = _joined(links)
    # what each class has in common with its pivot; one without a pivot is its own
    known = checked.join(whole.select(F.col("fp").alias("a")).distinct(), "a", "left_semi")
    pivots = known.groupBy(F.col("b").alias("fp")).agg(F.max(F.struct("common", "a")).alias("x")).select("fp", F.col("x.a").alias("pivot"), F.col("x.common").alias("held"))
    pivots = materialize(pivots)

    def placed(df: DataFrame) -> DataFrame:
        near = _with_component(df, comp).join(pivots, "fp", "left")
        return near.withColumns({"pivot": F.coalesce("pivot", "fp"), "held": F.coalesce("held", "n")})

    rest = materialize(_rest(placed(rows)).unionAll(_outside(placed(whole))))
    discard(rows, whole, comp, pivots)
    verified.append(_verified(docs, classes, rest))
    comp = _joined(links.unionAll(verified[-1].filter("linked").select("a", "b")))
    named = comp.withColumnRenamed("node", "fp")
    grouped = materialize(classes.join(named, "fp", "left").select("fp", "rep", "copies", F.coalesce("component", "fp").alias("component")))
    discard(rest, classes, comp, *verified)
    # min() of an id passes over nulls, so a group has none only if all of its ids are null
    least = grouped.groupBy("component").agg(F.min("rep.doc_id").alias("component_id"), F.min("rep").alias("chosen"), F.sum("copies").alias("members")).filter("members > 1")
    return sig, grouped.select("fp", "component").join(least, "component")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (columns doc_id and text; others are left out).

    component_id is the least doc_id reachable by links of Jaccard similarity 0.75 or more. Texts that
    are null or have no words have no shingles and their own id. Rows with equal sets are linked; rows that repeat a
    doc_id with other texts are documents of their own; a null doc_id keeps its place in groups but is
    never their least id. An id may be of any type that has an order. Tokens of equal frequency stand in order of their hash.
    An empty table gives no rows."""
    sig, groups = _grouped(docs)
    rows = sig.select("doc_id", F.col("n").alias("n_shingles"), "fp").join(groups.select("fp", "component_id"), "fp", "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _with_component(rows: DataFrame, comp: DataFrame) -> DataFrame:
    return rows.join(comp.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("comp", F.coalesce("component", "fp")).drop("component")


def drop_near(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates stays: that of the least doc_id, with all columns of docs.

    A row counts as a document by its id and text together, so another text under the id of a dropped one stays. Of rows
    with the same id and text one stays; of rows with a null id one stays if no row of the group has an id. Null texts and
    texts without words are in no group, so they all stay. An empty table stays empty."""
    sig, groups = _grouped(docs)
    rows = sig.select("doc_id", "th", "fp").join(groups.select("fp", "chosen"), "fp")
    mine = F.col("doc_id").eqNullSafe(F.col("chosen.doc_id")) & (F.col("th") == F.col("chosen.th"))
    found = materialize(rows.groupBy("doc_id", "th").agg(F.first(mine).alias("stays"), F.count("*").alias("rows")))
    gone, twice = found.filter("not stays").select("doc_id", "th"), found.filter("stays and rows > 1").select("doc_id", "th")
    th = "_th"
    while th in map(str.lower, docs.columns):
        th = f"_{th}"
    kept = docs.withColumn(th, F.xxhash64(F.col("text").cast("string")))
    kept = _meet(kept, gone, "left_anti", gone.count(), th)
    many = twice.count()
    if many:
        once = _meet(kept, twice, "left_semi", many, th).dropDuplicates(["doc_id", th])
        kept = _meet(kept, twice, "left_anti", many, th).unionByName(once)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
