"""Interval algebra and overlap joins. Intervals are closed, in columns start and stop, within +-2^62.

Overlap joins meet in bins of several widths. An interval has the width that is at least its length, so it touches two bins at most,
however long it is. Of a pair the longer one is listed in its own bins, the shorter one in the bins of that width; a pair counts in
the later of its two first bins only, so that none is seen twice and no distinct is needed. Bins that a count
finds hot are dealt over several tasks: each side's rows by their hash, to meet all shares of the other.

Unions and complements go along the sorted intervals. Each bin of starts is swept by itself; what reaches into it from the bins before is
a running maximum over one row a bin, taken in groups of bins, groups of groups and so on, so no task has more than one group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codonweave import session
from codonweave.operators.rounds import by_place
from codonweave.session import materialize, scratch

#: Least width of the bins of overlap joins, and by how many bits the next widths are larger.
BIN, STEP = 1 << 12, 3
#: Rows of a side that one task gets of a bin, about.
HOT = 1 << 14
#: Bins whose counts or shares are broadcast at most.
FEW = 100_000
#: Width of the bins of starts that are swept one by one: no bin has more different starts. Bits of a group of bins, and bins up to which none are formed.
SWEEP, GROUP, MANY_BINS = 1 << 16, 16, 1 << 20

#: Points that a leaf or a share of one has, about; points that cuts are taken from, and how often space is halved at most.
SHARE, SAMPLE, MOST_DEPTH = 1 << 16, 20_000, 12
#: Boxes of one shape that are listed in one row, about.
ALIKE = 1 << 10

_TOP = 63


def _level(start: str, stop: str, base: int) -> Column:
    """Bits of an interval's width: the first of base, base + STEP, ... and _TOP that its length does not exceed."""
    more = F.try_subtract(F.col(stop), F.col(start))  # null beyond 2^63
    wider = F.ceil((F.length(F.bin(more)) - base) / STEP).cast("int")
    return F.when(more < F.lit(1 << base), F.lit(base)).otherwise(F.coalesce(F.least(F.lit(_TOP), base + STEP * wider), F.lit(_TOP)))


def _own_spots(df: DataFrame, start: str, stop: str, base: int) -> DataFrame:
    """Each row in its own bins: _level, _bin, and _first, the first of the one or two."""
    rows = df.withColumn("_level", _level(start, stop, base))
    return rows.withColumns({"_first": F.expr(f"shiftright({start}, _level)"), "_bin": F.explode(F.expr(f"array_distinct(array(shiftright({start}, _level), shiftright({stop}, _level)))"))})


def _probing_spots(df: DataFrame, start: str, stop: str, base: int, levels: list[int], strict: bool) -> DataFrame:
    """Each row in the bins of all the given levels from its own on (strict: beyond its own); _level, _bin, _first."""
    own = _level(start, stop, base)
    kind = "array<struct<level:int,bin:bigint,first:bigint>>"
    spots = []
    for bits in levels:
        at = F.array_distinct(F.array(*[F.struct(F.lit(bits).alias("level"), F.shiftright(F.col(c), bits).alias("bin"), F.shiftright(F.col(start), bits).alias("first")) for c in (start, stop)]))
        spots.append(F.when(own < bits if strict else own <= bits, at).otherwise(F.array().cast(kind)))
    rows = df.withColumn("_spot", F.explode(F.concat(*spots)))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_spot.level").alias("_level"), F.col("_spot.bin").alias("_bin"), F.col("_spot.first").alias("_first"))


def _share(df: DataFrame, shares: Column) -> Column:
    """Which of so many shares a row is dealt to, by all of it that can be hashed."""
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.pmod(F.xxhash64(*plain), shares)


def _hot(stored: DataFrame, probing: DataFrame, on: list[str], levels: list[int], strict: bool) -> DataFrame | None:
    """(on, _level, _bin, _s, _p): shares of the stored and of the probing side in bins where one of them is hot; None without such bins.

    stored, probing: (on, _level, _bin, n) of their rows' own bins, from which those of wider bins follow."""
    spot = F.explode(F.array(*[F.struct(F.lit(bits).alias("level"), F.lit(bits).alias("bits")) for bits in levels]))
    wide = probing.select(*on, F.col("_level").alias("_l"), F.col("_bin").alias("_b"), "n", spot.alias("_w")).filter(F.col("_w.level") > F.col("_l") if strict else F.col("_w.level") >= F.col("_l"))
    wide = wide.select(*on, F.col("_w.level").alias("_level"), F.expr("shiftright(_b, _w.level - _l)").alias("_bin"), "n").groupBy(*on, "_level", "_bin").agg(F.sum("n").alias("m"))
    both = stored.join(wide, [*on, "_level", "_bin"]).filter((F.col("n") > HOT) | (F.col("m") > HOT))
    shares = both.select(*on, "_level", "_bin", F.ceil(F.col("n") / HOT).cast("long").alias("_s"), F.ceil(F.col("m") / HOT).cast("long").alias("_p"))
    hot = session.stored(shares)
    return None if hot.isEmpty() else hot


def _dealt(rows: DataFrame, hot: DataFrame, on: list[str], few: bool, stored: bool) -> DataFrame:
    """rows with _s and _p: their own share of hot bins, and all shares of the other side."""
    out = rows.join(F.broadcast(hot) if few else hot, [*on, "_level", "_bin"], "left").withColumns({"_s": F.coalesce("_s", F.lit(1)), "_p": F.coalesce("_p", F.lit(1))})
    mine, other = ("_s", "_p") if stored else ("_p", "_s")
    out = out.withColumn(mine, _share(rows, F.col(mine)))
    return out.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))


class _Side:
    """One side of an overlap join: its rows, names of its interval's columns, levels of its rows and the counts of its bins."""

    def __init__(self, rows: DataFrame, start: str, stop: str, written: bool = False) -> None:
        rows = rows.filter(f"{start} <= {stop}")
        self.rows, self.start, self.stop = rows if written else session.stored(rows), start, stop

    def spots(self, on: list[str], base: int) -> DataFrame:
        own = self.rows.select(*[F.col(f"`{c}`") for c in on], self.start, self.stop)
        return _own_spots(own, self.start, self.stop, base).groupBy(*on, "_level", "_bin").agg(F.count("*").alias("n"))


def _meetings(a: _Side, b: _Side, on: list[str], base: int, how: str) -> list[DataFrame]:
    """Joins of a's with b's rows that between them find every overlapping pair once (how: inner) or a's rows that have one (left_semi)."""
    counts = session.stored(a.spots(on, base).withColumn("_side", F.lit(0)).unionByName(b.spots(on, base).withColumn("_side", F.lit(1))))
    known = {side: (sorted(levels), rows) for side, levels, rows in counts.groupBy("_side").agg(F.collect_set("_level"), F.sum("n")).collect()}
    if len(known) < 2:
        return []
    (levels_a, rows_a), (levels_b, rows_b) = known[0], known[1]
    out = []
    # the stored side lies in its own bins, which are at least as wide as those of the probing side
    for stored, probing, levels, least, strict, side in ((a, b, levels_a, levels_b[0], False, 0), (b, a, levels_b, levels_a[0], True, 1)):
        wanted = [x for x in levels if x > least or not strict and x == least]
        if not wanted:
            continue
        left = _own_spots(stored.rows, stored.start, stored.stop, base)
        right = _probing_spots(probing.rows, probing.start, probing.stop, base, wanted, strict)
        keys = [*on, "_level", "_bin"]
        if max(rows_a, rows_b) > HOT:
            own, other = (counts.filter(f"_side = {x}").drop("_side") for x in (side, 1 - side))
            if (hot := _hot(own, other, on, wanted, strict)) is not None:
                few = hot.count() <= FEW
                left, right = _dealt(left, hot, on, few, True), _dealt(right, hot, on, few, False)
                keys += ["_s", "_p"]
        x, y = (left, right) if side == 0 else (right, left)  # a's rows stand left
        y = y.withColumnsRenamed({"_first": "_first2"} | {k: f"{k}_2" for k in keys})
        meet = [F.col(k) == F.col(f"{k}_2") for k in keys] + [F.col("start") <= F.col("b_stop"), F.col("b_start") <= F.col("stop")]
        if how == "inner":
            meet.append(F.col("_bin") == F.greatest("_first", "_first2"))
        out.append(x.join(y, reduce(Column.__and__, meet), how))
    return out


def overlap_join(a: DataFrame, b: DataFrame, on: list[str], width: int = BIN, how: str = "inner", written: bool = False) -> DataFrame:
    """Pairs of a row of a and a row of b that agree on the columns `on` and overlap.

    b's start and stop become b_start and b_stop; other columns of b must have names of their own. width: of the smallest bins.
    how: inner, left_semi or left_anti; then only rows of a come back, each as often as a has it. A row whose interval or key
    is null, or whose stop is before its start, overlaps nothing; nulls in other columns do not matter. Levels and hot bins come from one count of
    both sides' bins, which runs at once; as the sides are then read again, each is written once. written: a is read from
    a table as it is and needn't be."""
    base = max(0, (width - 1).bit_length())
    other = b.withColumnsRenamed({"start": "b_start", "stop": "b_stop"})
    if how == "inner":
        right = _Side(other, "b_start", "b_stop")
        found = _meetings(_Side(a, "start", "stop", written), right, on, base, how)
        names = [*a.columns, *[c for c in right.rows.columns if c not in on]]
        if not found:
            return a.limit(0).join(right.rows.limit(0), on).select(*[F.col(f"`{c}`") for c in names])
        return reduce(DataFrame.unionByName, [x.select(*[F.col(f"`{c}`") for c in names]) for x in found])
    rows = session.stored(a.withColumn("_row", F.monotonically_increasing_id()))  # a number that stays, whatever a's columns are
    left = _Side(rows.select("_row", *[F.col(f"`{c}`") for c in on], "start", "stop"), "start", "stop", written=True)
    spots = other.select(*[F.col(f"`{c}`") for c in on], "b_start", "b_stop")
    found = _meetings(left, _Side(spots, "b_start", "b_stop"), on, base, "left_semi")
    hits = reduce(DataFrame.unionAll, [x.select("_row") for x in found]).distinct() if found else rows.select("_row").limit(0)
    return rows.join(hits, "_row", how).select(*[F.col(f"`{c}`") for c in a.columns])


def _before(bins: DataFrame, bits: int, back: bool = False) -> DataFrame:
    """One row (_k, _bin, v) a bin, to (_k, _bin, _x): the greatest v of all bins before (back: the least of all bins behind), by key _k.

    bins: a written table. Where it is long, bins are taken in groups of 2^GROUP by a window each; what the groups before have comes from
    the same on the table of groups. bits: of _bin. The result is broadcast where a count allows it."""
    order, best = (F.desc("_bin"), F.min) if back else (F.asc("_bin"), F.max)
    rows = bins.count()

    def ahead(df: DataFrame, left: int) -> DataFrame:
        grouped = left > GROUP and rows > MANY_BINS
        df = df.withColumn("_group", F.shiftright("_bin", GROUP) if grouped else F.lit(0).cast("long"))
        w = W.partitionBy("_k", "_group").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        inner = df.select("_k", "_group", "_bin", best("v").over(w).alias("_x"))
        if not grouped:
            return inner.drop("_group")
        groups = df.groupBy("_k", "_group").agg(best("v").alias("v")).withColumnRenamed("_group", "_bin")
        above = ahead(groups, left - GROUP).withColumnsRenamed({"_bin": "_group", "_x": "_y"})
        return inner.join(above, ["_k", "_group"], "left").select("_k", "_bin", (F.least if back else F.greatest)("_x", "_y").alias("_x"))

    out = ahead(bins, bits)
    return F.broadcast(out) if rows <= FEW else out


def _longest(df: DataFrame, keys: list[str], width: int) -> tuple[DataFrame, DataFrame]:
    """Written: (_k, _bin, start, stop), the longest interval of each start by key _k and bin of starts; and (_k, _bin, v) with the last base of each bin's.

    A key is a struct, in which nulls are equal."""
    bits = (width - 1).bit_length()
    rows = df.filter("start <= stop").groupBy(F.struct(*keys).alias("_k"), "start").agg(F.max("stop").alias("stop"))
    rows = materialize(rows.select("_k", F.shiftright("start", bits).alias("_bin"), "start", "stop"))
    return rows, materialize(rows.groupBy("_k", "_bin").agg(F.max("stop").alias("v")))


def _swept(rows: DataFrame, bins: DataFrame, width: int) -> DataFrame:
    """The rows of _longest() with _before: the last base of what begins earlier, null at the first of a key."""
    reach = F.max("stop").over(W.partitionBy("_k", "_bin").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    own = rows.select("_k", "_bin", "start", "stop", reach.alias("_reach"))
    came = _before(bins, 64 - (width - 1).bit_length())
    return own.join(came, ["_k", "_bin"], "left").select("_k", "_bin", "start", "stop", F.greatest("_reach", "_x").alias("_before"))


def islands(rows: DataFrame, bins: DataFrame, width: int = SWEEP) -> DataFrame:
    """(_k, _bin, start, _before) of the rows of _longest() that begin beyond all that begin earlier; adjacent ones don't."""
    return _swept(rows, bins, width).filter(F.col("_before").isNull() | (F.col("start") > F.col("_before") + 1)).drop("stop")


def gaps(df: DataFrame, keys: list[str], width: int = SWEEP) -> DataFrame:
    """(keys, start, stop): what lies between the first and the last base of each key outside its intervals."""
    begun = islands(*_longest(df, keys, width), width).filter("_before is not null")
    return begun.select(*[F.col(f"_k.`{k}`") for k in keys], (F.col("_before") + 1).alias("a"), (F.col("start") - 1).alias("stop")).withColumnRenamed("a", "start")


def clusters(df: DataFrame, keys: list[str], width: int = SWEEP) -> DataFrame:
    """(_k, _bin, start, stop): the longest interval of each start, with _island, the first base of their chain of overlapping intervals, and _over, whether that began in an earlier bin.

    A chain's first interval may lie in an earlier bin: its place is a running maximum over bins, as what reaches into a bin is."""
    bits = 64 - (width - 1).bit_length()
    rows = _swept(*_longest(df, keys, width), width)
    rows = materialize(rows.withColumn("_new", F.when(F.col("_before").isNull() | (F.col("start") > F.col("_before")), F.col("start"))))
    last = _before(materialize(rows.groupBy("_k", "_bin").agg(F.max("_new").alias("v"))), bits)
    w = W.partitionBy("_k", "_bin").orderBy("start").rowsBetween(W.unboundedPreceding, 0)
    named = rows.withColumn("_own", F.max("_new").over(w)).join(last, ["_k", "_bin"], "left").withColumn("_island", F.coalesce("_own", "_x"))
    return named.select("_k", "_bin", "start", "stop", "_island", F.col("_own").isNull().alias("_over"))


def union_regions(df: DataFrame, keys: list[str], width: int = SWEEP) -> DataFrame:
    """Disjoint intervals that cover what df covers, by key; adjacent ones become one. Rows with a null end are left out.

    An island ends where the next one's _before says; the next of a bin's last island stands in a later bin, and behind the last of a key
    stands a row with the key's last base."""
    bits = 64 - (width - 1).bit_length()
    with scratch() as keep:
        rows, bins = _longest(df, keys, width)
        begun = keep(materialize(islands(rows, bins, width)))
        last = bins.groupBy("_k").agg(F.max("v").alias("v")).select("_k", F.lit(1 << (bits - 1)).cast("long").alias("_bin"), "v")
        first = keep(materialize(begun.groupBy("_k", "_bin").agg(F.min("_before").alias("v")).unionByName(last)))
    following = F.lead("_before").over(W.partitionBy("_k", "_bin").orderBy("start"))
    rows = begun.withColumn("_next", following).join(_before(first, bits, back=True), ["_k", "_bin"], "left")
    return rows.select(*[F.col(f"_k.`{k}`") for k in keys], "start", F.coalesce("_next", "_x").alias("stop"))


def intersect_regions(a: DataFrame, b: DataFrame, keys: list[str], *more: DataFrame) -> DataFrame:
    """The parts common to all tables, by key. Each table's own intervals should be disjoint."""
    both = overlap_join(a.select(*keys, "start", "stop"), b.select(*keys, "start", "stop"), keys)
    out = both.select(*keys, F.greatest("start", "b_start").alias("start"), F.least("stop", "b_stop").alias("stop"))
    return intersect_regions(out, more[0], keys, *more[1:]) if more else out


def complement_region(df: DataFrame, keys: list[str], lo: Column | int, hi: Column | int, among: DataFrame | None = None, width: int = SWEEP, cut: bool = True) -> DataFrame:
    """What lies from lo to hi outside the intervals of each key.

    cut: gaps between two intervals end at lo and hi. If not, they stay whole wherever they lie; lo and hi then bound only what
    lies before the first and behind the last interval.

    among: a table of all keys, one row each; lo and hi may then be columns of it, as chromosome sizes are. A key without
    intervals gives its whole range. Without it the keys are those of df. Any bounds within +-2^62 will do; the work depends on the intervals alone."""
    fixed = among is None
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    rows, bins = _longest(df, keys, width)
    begun, ends = islands(rows, bins, width), bins.groupBy("_k").agg(F.max("v").alias("_end"))
    if fixed:
        begun, ends = (x.withColumns({"_lo": lo.cast("long"), "_hi": hi.cast("long")}) for x in (begun, ends))
    else:
        named = among.select(F.struct(*keys).alias("_k"), lo.cast("long").alias("_lo"), hi.cast("long").alias("_hi"))
        begun, ends = begun.join(named, "_k"), named.join(ends, "_k", "left")
    start, stop = F.coalesce(F.col("_before") + 1, "_lo"), F.col("start") - 1
    inner = begun.select("_k", (F.greatest(start, "_lo") if cut else start).alias("a"), (F.least(stop, "_hi") if cut else stop).alias("b"))
    after = F.coalesce(F.col("_end") + 1, "_lo")
    tail = ends.select("_k", (F.greatest(after, "_lo") if cut else after).alias("a"), F.col("_hi").alias("b"))
    return inner.unionByName(tail).filter("a <= b").select(*[F.col(f"_k.`{k}`") for k in keys], F.col("a").alias("start"), F.col("b").alias("stop"))


def gaps_inside(pieces: DataFrame, key: list[str]) -> DataFrame:
    """What each interval (key, start, stop) has left after its pieces (b_start, b_stop; null: none)."""
    w = W.partitionBy(*key).orderBy("b_start", "b_stop")
    reach = F.coalesce(F.max("b_stop").over(w.rowsBetween(W.unboundedPreceding, -1)), F.col("start") - 1)
    steps = pieces.select(*key, "start", "stop", "b_start", "b_stop", reach.alias("_reach"))
    inner = steps.select(*key, F.greatest(F.col("_reach") + 1, F.col("start")).alias("left_start"), F.least(F.coalesce(F.col("b_start") - 1, F.col("stop")), F.col("stop")).alias("left_stop"))
    tail = pieces.groupBy(*key, "start", "stop").agg(F.max("b_stop").alias("_reach")).filter("_reach < stop")
    tail = tail.select(*key, (F.col("_reach") + 1).alias("left_start"), F.col("stop").alias("left_stop"))
    return inner.unionByName(tail).filter("left_start <= left_stop")


def subtract_regions(a: DataFrame, b: DataFrame, keys: list[str], row: str) -> DataFrame:
    """The parts of each row of a (named by the column row) that no interval of b covers; a row of a null key is covered by nothing.

    They are what the row has in common with the gaps of b, so no row's pieces are laid together."""
    own, bound = a.select(row, *keys, "start", "stop").filter("start <= stop"), 1 << 62
    own = materialize(own)
    cut = overlap_join(own, complement_region(b, keys, -bound, bound), keys, written=True)
    left = cut.select(row, *keys, F.greatest("start", "b_start").alias("start"), F.least("stop", "b_stop").alias("stop"))
    return left.unionByName(own.join(b.filter("start <= stop").select(*keys).distinct(), keys, "left_anti").select(left.columns))


def overlapping_transcripts(intervals: DataFrame, segments: DataFrame, row: str, strands: list[str] | None = None, unique: bool = False) -> DataFrame:
    """Distinct (row, tr_id): transcripts with a segment (tr_id, chrom, strand, start, stop) that overlaps an interval.

    intervals: several rows may share a name, unless `unique` says that none do. Then no pairs are compared: of a transcript's segments in order that overlap an
    interval, the first is the one before which all others end before it, and many intervals go in rounds. strands: of the segments; both if left out."""
    own = segments if strands is None else segments.filter(F.col("strand").isin(strands))
    own, rows = own.filter("start <= stop").select("chrom", "start", "stop", "tr_id"), intervals.select(row, "chrom", "start", "stop")
    if not unique:
        return overlap_join(rows, own, ["chrom"]).select(row, "tr_id").distinct()
    earlier = W.partitionBy("tr_id", "chrom").orderBy("start", "stop").rowsBetween(W.unboundedPreceding, -1)
    own = session.stored(own.withColumn("_past", F.max("stop").over(earlier)))

    def part(a: DataFrame, b: DataFrame) -> DataFrame:
        return overlap_join(a, b, ["chrom"], written=True).filter("_past is null or _past < start").select(row, "tr_id")

    return by_place(session.once(rows, intervals), [own], part)


def _splits(sample: list[tuple[float, float]], depth: int) -> list[float]:
    """Thresholds of a full tree of that depth that halves a sample of points by x and y in turn; node k has the children 2 k and 2 k + 1."""
    out = [float("inf")] * (1 << depth)
    parts = {1: sample}
    for node in range(1, 1 << depth):
        own = parts.pop(node)
        axis = (node.bit_length() - 1) % 2
        if own:
            out[node] = sorted(p[axis] for p in own)[(len(own) - 1) // 2]
        parts[2 * node] = [p for p in own if p[axis] <= out[node]]
        parts[2 * node + 1] = [p for p in own if p[axis] > out[node]]
    return out


def _shapes(boxes: DataFrame) -> DataFrame:
    """(xmin, xmax, ymin, ymax, _boxes): what else the rows with these ends have, in lists of ALIKE or so; equal rows share a list."""
    ends = ["xmin", "xmax", "ymin", "ymax"]
    rows = boxes.select(*ends, F.struct(*[F.col(f"`{c}`") for c in boxes.columns if c not in ends] or [F.lit(0)]).alias("_box"), _share(boxes, F.lit(1 << 62)).alias("_spot"))
    many = boxes.groupBy(*ends).agg(F.ceil(F.count("*") / ALIKE).cast("long").alias("_n")).filter("_n > 1")
    rows = rows.join(many, ends, "left").withColumn("_list", F.col("_spot") % F.coalesce("_n", F.lit(1)))
    return rows.groupBy(*ends, "_list").agg(F.collect_list("_box").alias("_boxes")).drop("_list")


def points_in_boxes(points: DataFrame, boxes: DataFrame, share: int = SHARE) -> DataFrame:
    """Each point (x, y, ...) with each box (xmin, xmax, ymin, ymax, ...) that holds it, edges included; a null coordinate is nowhere.

    Space is cut into leaves by halving a sample of points, bounded by SAMPLE; the cuts decide where pairs meet, not which. Boxes of one shape
    are compared once, in lists of ALIKE or so, and listed in each leaf that they touch. Points of a leaf that has more than `share` of them, as where one place repeats, are dealt over
    several shares, to each of which the leaf's boxes go."""
    own = points.filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    rows = own.count()
    depth = min(MOST_DEPTH, max(0, (-(-rows // share) - 1).bit_length()))
    if depth:
        odds = max(1, 2 * rows // SAMPLE)
        sample = own.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, kind in points.dtypes if "map<" not in kind]), F.lit(odds)) == 0).limit(SAMPLE)
        splits = F.array(*map(F.lit, _splits([tuple(r) for r in sample.collect()], depth)))
    else:
        splits = F.array(F.lit(float("inf")))
    levels = F.array(*[F.lit(k) for k in range(depth)]) if depth else F.array().cast("array<int>")

    def at(level: Column, a: str, b: str) -> Column:
        return F.when(level % 2 == 0, F.col(a).cast("double")).otherwise(F.col(b).cast("double"))

    leaf = F.aggregate(levels, F.lit(1), lambda node, k: 2 * node + (at(k, "x", "y") > F.element_at(splits, node + 1)).cast("int"))
    nodes = F.aggregate(levels, F.array(F.lit(1)), lambda ns, k: F.flatten(F.transform(ns, lambda n: F.concat(
        F.when(at(k, "xmin", "ymin") <= F.element_at(splits, n + 1), F.array(2 * n)).otherwise(F.array().cast("array<int>")),
        F.when(at(k, "xmax", "ymax") > F.element_at(splits, n + 1), F.array(2 * n + 1)).otherwise(F.array().cast("array<int>")),
    ))))
    p = own.withColumn("_leaf", leaf)
    b = _shapes(boxes.filter("xmin <= xmax and ymin <= ymax")).withColumn("_leaf", F.explode(nodes))
    sizes = p.groupBy("_leaf").agg(F.ceil(F.count("*") / share).cast("long").alias("_n")).filter("_n > 1")  # of 2^MOST_DEPTH leaves at most
    p = p.join(F.broadcast(sizes), "_leaf", "left").withColumn("_s", _share(own, F.coalesce("_n", F.lit(1).cast("long")))).drop("_n")
    b = b.join(F.broadcast(sizes), "_leaf", "left").withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_n", F.lit(1)) - 1))).drop("_n")
    inside = F.col("x").between(F.col("xmin"), F.col("xmax")) & F.col("y").between(F.col("ymin"), F.col("ymax"))
    # the tables are small beside their pairs, so a merge in as many tasks as the session has, not in as few as the tables' size would give
    p = p.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_leaf", "_s")
    pairs = p.join(b.hint("merge"), ["_leaf", "_s"]).filter(inside).withColumn("_box", F.explode("_boxes"))
    return pairs.select(*[F.col(f"`{c}`") for c in points.columns], *[F.col(f"`{c}`" if c in pairs.columns else f"_box.`{c}`") for c in boxes.columns])


def intervals_length(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.col("stop") - F.col("start") + 1).alias("bases"))


def intervals_prefix(df: DataFrame, keys: list[str], n: int | Column, strand: str = "strand") -> DataFrame:
    """The first n bases of each key's intervals in the direction of its strand; all of them if there are fewer.

    A negative n is an error."""
    if isinstance(n, int) and n < 0:
        raise ValueError("n must not be negative")
    n = n if isinstance(n, Column) else F.lit(n).cast("long")
    plus = F.col(strand) == "+"
    w = W.partitionBy(*keys).orderBy(F.when(plus, F.col("start")).otherwise(-F.col("start"))).rowsBetween(W.unboundedPreceding, -1)
    size = F.col("stop") - F.col("start") + 1
    left = df.withColumn("_left", n - F.coalesce(F.sum(size).over(w), F.lit(0)))
    return left.filter("_left > 0").withColumns({
        "start": F.when(plus, F.col("start")).otherwise(F.greatest("start", F.col("stop") - F.col("_left") + 1)),
        "stop": F.when(plus, F.least("stop", F.col("start") + F.col("_left") - 1)).otherwise(F.col("stop")),
    }).drop("_left")


def intervals_suffix(df: DataFrame, keys: list[str], n: int | Column, strand: str = "strand") -> DataFrame:
    """The last n bases, likewise."""
    flipped = df.withColumn("_as", F.when(F.col(strand) == "+", F.lit("-")).otherwise(F.lit("+")))
    return intervals_prefix(flipped, keys, n, "_as").drop("_as")


def with_next(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each row with the given columns of its successor (next_...); the last of a key has none and is left out."""
    w = W.partitionBy(*keys).orderBy(*order)
    out = df.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns} | {"_more": F.lead(F.lit(1)).over(w)})
    return out.filter("_more = 1").drop("_more")


def run_ids(df: DataFrame, keys: list[str], order: list[str], goes_on: Column, name: str = "run") -> DataFrame:
    """Numbers the runs of each key from 1; goes_on says, in terms of lag() over `order`, whether a row continues the run."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_goes", goes_on).withColumn(name, F.sum(F.when(F.coalesce("_goes", F.lit(False)), 0).otherwise(1)).over(w)).drop("_goes")
