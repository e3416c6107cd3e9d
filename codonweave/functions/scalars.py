"""Column functions on strands, sequences, region strings and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def antistrand(strand: Column | str) -> Column:
    """'+' for '-' and the reverse; other symbols stay."""
    s = col(strand)
    return F.when(s == "+", F.lit("-")).when(s == "-", F.lit("+")).otherwise(s)


def anti_shift(strand: Column | str) -> Column:
    """By how much the antisense interval of a codon-aligned interval is shifted."""
    return F.when(col(strand) == "+", F.lit(2)).otherwise(F.lit(-2)).cast("long")


def anti_interval(start: Column | str, stop: Column | str, strand: Column | str) -> Column:
    """struct(start, stop, strand) of the antisense interval."""
    by = anti_shift(strand)
    return F.struct((col(start) + by).alias("start"), (col(stop) + by).alias("stop"), antistrand(strand).alias("strand"))


def anti_intervals(intervals: Column | str, strand: Column | str) -> Column:
    """The same for an array of struct(start, stop)."""
    by = anti_shift(strand)
    return F.transform(col(intervals), lambda x: F.struct((x["start"] + by).alias("start"), (x["stop"] + by).alias("stop")))


def region_string(chrom: Column | str, start: Column | str, stop: Column | str) -> Column:
    """'chrom:start-stop'; null if any part is."""
    return F.concat(col(chrom), F.lit(":"), col(start).cast("string"), F.lit("-"), col(stop).cast("string"))


def regions_string(chrom: Column | str, intervals: Column | str) -> Column:
    """'chrom:s-e+chrom:s-e...' of an array of struct(start, stop)."""
    return F.array_join(F.transform(col(intervals), lambda x: region_string(chrom, x["start"], x["stop"])), "+")


def region_name(chrom: Column | str, start: Column | str, stop: Column | str, strand: Column | str) -> Column:
    return F.concat(region_string(chrom, start, stop), F.lit(":"), col(strand))


_REGION = r"^\s*(.+):(-?[0-9,]+)-(-?[0-9,]+)\s*$"


def parse_regions(text: Column | str) -> Column:
    """array<struct(chrom, start, stop)> of a region string; null if any part is malformed."""

    def number(part: Column, group: int) -> Column:
        return F.regexp_replace(F.regexp_extract(part, _REGION, group), ",", "").try_cast("long")

    parts = F.transform(F.split(col(text), r"\+"), lambda p: F.struct(F.regexp_extract(p, _REGION, 1).alias("chrom"), number(p, 2).alias("start"), number(p, 3).alias("stop")))
    bad = F.exists(parts, lambda p: (p["chrom"] == "") | p["start"].isNull() | p["stop"].isNull())
    return F.when(~bad, parts)


def reverse_complement(seq: Column | str, rna: bool = False) -> Column:
    """Case is kept and other letters stay. A U in DNA or a T in RNA gives null."""
    s = col(seq)
    pairs = ("ACGUacgu", "UGCAugca") if rna else ("ACGTacgt", "TGCAtgca")
    return F.when(~s.rlike("[Tt]" if rna else "[Uu]"), F.reverse(F.translate(s, *pairs)))


def map_to_strand(seq: Column | str, strand: Column | str, rna: bool = False) -> Column:
    return F.when(col(strand) == "-", reverse_complement(seq, rna)).otherwise(col(seq))


def prob_to_log_odds(p: Column | str) -> Column:
    """log10 of the odds, from -15 to 15."""
    p, most = col(p), 15.0
    return F.when(p <= 0, F.lit(-most)).when(p >= 1, F.lit(most)).otherwise(F.greatest(F.lit(-most), F.least(F.lit(most), F.log10(p / (1 - p)))))


def gray_scale(log_odds: Column | str) -> Column:
    """One of eight greys, from 210 (below 1) to 0 (above 7)."""
    x = col(log_odds)
    return F.when(x < 1, F.lit(210)).when(x > 7, F.lit(0)).otherwise(210 - 30 * F.floor(x)).cast("long")


# The rank at the middle of the colour scale, and its bins.
MIDDLE_RANK, COLOR_BINS = 5_000, 8


def rank_color(rank0: Column | str, n: Column | int, strand: Column | str) -> Column:
    """'r,g,b' of a zero-based rank among n, in eight bins of a logarithmic scale; paler with the rank.

    Where the scale degenerates (n = 10,000) bins are linear; where its end is infinite (n = 5,000) all are bin 0."""
    i, n = col(rank0).cast("double"), (F.lit(n) if isinstance(n, int) else n).cast("double")
    a = (n - 2 * MIDDLE_RANK) / MIDDLE_RANK**2
    end = 1 + a * n
    scaled = F.when(a == 0, i / n).when(end <= 0, F.lit(0.0)).otherwise(F.log(1 + a * i) / F.log(end))
    part = F.floor(COLOR_BINS * scaled) / COLOR_BINS

    def channel(full: Column) -> Column:
        return F.floor(full * (1 - part) + 255 * part).cast("long").cast("string")

    plus = col(strand) == "+"
    return F.concat_ws(",", *[channel(F.when(plus, F.lit(float(p))).otherwise(F.lit(float(m)))) for p, m in ((0, 200), (175, 0), (0, 0))])


def num_codons(start: Column | str, stop: Column | str) -> Column:
    return F.floor((col(stop) - col(start) + 1) / 3).cast("long")


def decibans_to_ratio(score: Column | str) -> Column:
    return F.pow(F.lit(10.0), col(score) / 10)


def is_int_string(text: Column | str) -> Column:
    return F.coalesce(F.trim(col(text)).rlike(r"^[+-]?[0-9]+$"), F.lit(False))


def is_number_string(text: Column | str) -> Column:
    return F.coalesce(F.trim(col(text)).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.lit(False))


def without_trailing_digits(text: Column | str) -> Column:
    return F.regexp_replace(col(text), "[0-9]+$", "")


def without_trailing_char(text: Column | str, char: str) -> Column:
    """The text without one such character at its end."""
    return F.when(F.endswith(col(text), F.lit(char)), F.substring(col(text), F.lit(1), F.length(col(text)) - 1)).otherwise(col(text))


def without_trailing_newline(text: Column | str) -> Column:
    """The text without one line end (LF, CR or CR LF) at its end."""
    return without_trailing_char(without_trailing_char(text, "\n"), "\r")


def split_or_empty(text: Column | str, pattern: str) -> Column:
    """split(), but nothing of an empty text."""
    return F.when(col(text) == "", F.array().cast("array<string>")).otherwise(F.split(col(text), pattern))


def kmer_index(kmer: Column | str) -> Column:
    """The base-4 number of a k-mer (A, C, G, T are 0 to 3, the first base counts most); null for other letters."""
    k = col(kmer)
    return F.when(k.rlike("^[ACGT]+$"), F.conv(F.translate(k, "ACGT", "0123"), 4, 10).cast("long"))


def frame(pos: Column | str) -> Column:
    return F.pmod(col(pos), F.lit(3)).cast("long")
