"""Readers and writers, on files written here and on small fixtures."""

from __future__ import annotations

import gzip
import math
import random
import struct
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from codonweave.functions import scalars
from codonweave.operators import scoring, splice, transcripts
from codonweave.operators.transcripts import transcripts_from_bed
from codonweave.sources import readers, writers
from codonweave.streaming.codons import stream_usable_codons


def test_codon_scores(spark, tmp_path):
    (tmp_path / "a.out").write_text("chr1:4-6\t+\tscore(decibans)\t12.5\t0.7\nchr1:7-9 + No_Alignment\n\nchr1:10-12 + failure\n")
    rows = readers.read_codon_scores(spark, str(tmp_path / "a.out")).orderBy("pos").collect()
    assert [(r["pos"], r["frame"], r["score"], r["bls"]) for r in rows] == [(4, 1, 12.5, 0.7), (7, 1, None, None), (10, 1, None, None)]
    (tmp_path / "b.out").write_text("chr1:4-6 + No_Alignment\nchr1:5-7 + No_Alignment\n")
    with pytest.raises(ValueError):
        readers.read_codon_scores(spark, str(tmp_path / "b.out"))


def test_codon_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.out").write_text("chr1:4-6 + score(decibans) 1.0 0.7\nchr1:7-9 + score(decibans) 1.0 0.1\n")
    q = stream_usable_codons(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("codon_stream").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["pos"] for r in spark.table("codon_stream").collect()] == [4]


def test_bed_round_trip(spark, tmp_path):
    lines = ["chr1\t10\t50\tt1\t0\t+\t12\t45\t1,2,3\t2\t10,20\t0,20", "chr1\t5\t9\tr\t0\t-\t5\t9\t0,0,0\t1\t4\t0"]
    (tmp_path / "x.bed").write_text("track name=x\n# c\nbrowser y\n" + "\n".join(lines) + "\n")
    df = readers.read_bed(spark, str(tmp_path / "x.bed"))
    assert sorted(r["value"] for r in writers.to_bed12(df.withColumn("score", F.col("score"))).collect()) == sorted(lines)
    bad = spark.createDataFrame([("chr1\t1\t5\tn\t0\t+\t1\t5\t0\t1",), ("chr1\t1\t9\tn\t0\t+\t1\t5\t0\t2\t3\t0",), ("chr1\t1\t9\tn\t0\t+\t1\t5\t0\t1\t3,\t0,",)], "value string")
    assert all(r["error"] for r in readers.parse_bed(bad).collect())


def test_missing_bed_fields(spark, tmp_path):
    """Fields that a short line lacks are written as their defaults; what is written can be read."""
    (tmp_path / "x.bed").write_text("c\t3\t9\tn\t0\t+\n")
    df = readers.read_bed(spark, str(tmp_path / "x.bed"))
    lines = writers.to_bed12(df)
    assert lines.first()[0] == "c\t3\t9\tn\t0\t+\t3\t3\t0\t1\t6\t0"
    assert readers.parse_bed(lines).first()["error"] is None
    bare = df.withColumns({c: F.lit(None).cast("string") for c in ("name", "score", "strand")})
    assert writers.to_bed12(bare).first()[0] == "c\t3\t9\t.\t0\t.\t3\t3\t0\t1\t6\t0"
    assert writers.to_bed12(df.withColumn("chrom", F.lit(None).cast("string"))).first()[0] is None
    nine = spark.createDataFrame([("c", None, 4, 9, None), (None, "+", 4, 9, 30)], "chrom string, strand string, start long, stop long, gray long")
    assert [r[0] for r in writers.to_bed9(nine).collect()] == ["c\t3\t9\tc:4-9\t0\t.\t3\t9\t0,0,0", None]


FIXTURES = Path(__file__).parent / "fixtures"


def test_region_lines(spark):
    path = FIXTURES / "regions.Strand-.Frame1.coding.bed"
    df = readers.read_bed(spark, str(path))
    gray = df.withColumn("gray", F.split("rgb", ",")[0].cast("long"))
    assert sorted(r["value"] for r in writers.to_bed9(gray).collect()) == sorted(path.read_text().splitlines())
    assert {r[0] for r in df.select(scalars.frame("start")).collect()} == {1}


def test_transcript_lines(spark):
    path = FIXTURES / "transcripts.bed"
    df = readers.read_bed(spark, str(path))
    assert sorted(r["value"] for r in writers.to_bed12(df).collect()) == sorted(path.read_text().splitlines())
    got = {(r["tr_id"], r["idx"]): r for r in transcripts_from_bed(df).collect()}
    assert len(got) == 8
    # plus: coding from the 6th base of the first exon to the 5th of the last; minus: positions count from the right
    assert {(r["cs"], r["ce"]) for (t, _), r in got.items() if t == "plus"} == {(6, 35)}
    assert {(r["cs"], r["ce"]) for (t, _), r in got.items() if t == "minus"} == {(11, 25)}
    assert {(r["cs"], r["ce"]) for (t, _), r in got.items() if t in ("noncoding", "edge_in_intron")} == {(None, None)}
    assert [got["plus", i]["cum"] for i in (1, 2, 3)] == [0, 10, 30] and got["plus", 1]["len"] == 45


def test_candidate_colors(spark):
    """Colours by the published scale, worked out here once more for 12 of 3,000 ranks and both strands."""
    n = 3000
    df = spark.createDataFrame([("c", 3 * k + 1, 3 * k + 30, k, "+" if k % 2 else "-") for k in range(1, n + 1, 251)], "chrom string, start long, stop long, rank long, strand string")
    for r in scoring.candidates_bed(df, n).collect():
        a = (n - 10000) / 25e6
        part = math.floor(8 * math.log(1 + a * (int(r["name"]) - 1)) / math.log(1 + a * n)) / 8
        full = (0, 175, 0) if r["strand"] == "+" else (200, 0, 0)
        assert r["rgb"] == ",".join(str(math.floor(c * (1 - part) + 255 * part)) for c in full)


def test_fasta_over_splits(spark, tmp_path):
    rng = random.Random(9)
    want, text = [], ""
    for k, n in enumerate((0, 1, 40, 3, 0, 25)):
        text += f"> s{k} x \n" if k else ""
        at = 0
        for _ in range(n):
            line = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 60)))
            want.append((f"s{k} x", at, line))
            text += line + "\n" * rng.choice((1, 1, 2))
            at += len(line)
    (tmp_path / "x.fa").write_text(text)
    (tmp_path / "y.fa").write_text("ACG\nT\n>other\nGG\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    got = sorted((tuple(r) for r in readers.read_fasta(spark, str(tmp_path)).collect()), key=repr)
    parts = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert parts > 10 and got == sorted([*want, (None, 0, "ACG"), (None, 3, "T"), ("other", 0, "GG")], key=repr)


def test_splice_sites_over_chunks(spark):
    rng = random.Random(10)
    seqs = {f"s{k}": "".join(rng.choice("ACGTN" if k % 2 else "ACGT") for _ in range(n)) for k, n in enumerate((0, 5, 23, 300, 777, 64))}
    want = []
    flip = str.maketrans("ACGT", "TGCA")
    for name, s in seqs.items():
        for strand, x in (("+", s), ("-", s.translate(flip)[::-1])):
            for kind, motif, before, after in (("donor", "GT", 3, 4), ("acceptor", "AG", 18, 3)):
                for i in range(before, len(x) - 1 - after):
                    if x[i : i + 2] == motif:
                        want.append((name, strand, kind, i + 1 if strand == "+" else len(x) - i, x[i - before : i] + x[i + 2 : i + 2 + after]))
    pieces = []
    for name, s in seqs.items():
        at = 0
        while at < len(s):
            n = rng.randint(1, 90)
            pieces.append((name, at, s[at : at + n]))
            at += n
    df = spark.createDataFrame([*pieces, ("s0", 0, ""), ("none", 0, None)], "name string, offset long, seq string")
    for size in (23, 50, 1000):
        assert sorted(map(tuple, splice.splice_sites(splice.overlapping(df, size)).collect())) == sorted(want)
    assert len(want) > 100 and splice.splice_sites(df.limit(0)).count() == 0


def test_splice_scan_is_linear(spark):
    """Ten chunks of 80,000 bases in well under a second each."""
    df = spark.range(10).select(F.col("id").cast("string").alias("name"), F.lit(0).cast("long").alias("offset"), F.lit("ACGTTGAG" * 10_000).alias("seq"))
    splice.splice_sites(df).count()
    began = time.time()
    assert splice.splice_sites(df).count() > 10 * 10_000
    assert time.time() - began < 10


def test_donor_scores_of_a_file(spark, tmp_path):
    coef = [((i * 31) % 977 + 1) / 977 for i in range(4**7)]
    (tmp_path / "d.mecoef").write_bytes(struct.pack(f"<{4**7}d", *coef))
    table = readers.read_coefficients(spark, str(tmp_path / "d.mecoef"), [4**7])
    df = spark.createDataFrame([("TCAAAGG",), ("ACGTNAA",)], "context string")
    index = sum("ACGT".index(c) * 4 ** (6 - i) for i, c in enumerate("TCAAAGG"))
    rows = {r["context"]: r["donor_score"] for r in splice.donor_score(df, "context", table).collect()}
    assert rows["TCAAAGG"] == pytest.approx(math.log2(splice.DONOR_FACTOR * coef[index]), abs=1e-9) and rows["ACGTNAA"] is None
    with pytest.raises(ValueError):
        splice.donor_score(df, "context", table.limit(7))


def test_coding_exons_and_csv_tables(spark, tmp_path):
    (tmp_path / "e.txt").write_text("chr1\t+\t2\t10\t40\nchr2\t-\t0\t5\t7\n")
    assert sorted(map(tuple, readers.read_coding_exons(spark, str(tmp_path / "e.txt")).collect())) == [("chr1", "+", 2, 10, 40), ("chr2", "-", 0, 5, 7)]
    df = spark.createDataFrame([("1", "a"), (None, "b")], "v string, k string")
    writers.write_csv_table(df.coalesce(1), str(tmp_path / "out"), "k")
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part-*")).splitlines()[0] == "k,v"
    assert {r["k"]: r["v"] for r in readers.read_csv_table(spark, str(tmp_path / "out"), index="k").collect()} == {"a": "1", "b": None}
    (tmp_path / "bad.csv").write_text("k,v\na,1,2\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_csv_table(spark, str(tmp_path / "bad.csv"), index="k", strict=True).collect()


def test_regions_folder(spark, tmp_path):
    with gzip.open(tmp_path / "c.Strand+.Frame1.coding.bed.gz", "wt") as f:
        f.write("c\t3\t9\tc:4-9\t0\t+\t3\t9\t0,0,0\n")
    (tmp_path / "c.Strand-.Frame0.coding.bed").write_text("c\t2\t11\tc:3-11\t0\t-\t2\t11\t0,0,0\n")
    assert sorted(r["rid"] for r in readers.read_regions(spark, str(tmp_path)).collect()) == ["c:3-11:-", "c:4-9:+"]


def test_delimited(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# note\na\tb\tc\n1.10\t2\n\n\"q\"\tx\ty\n")
    df = readers.read_delimited(spark, str(tmp_path / "t.txt"))
    assert sorted(map(tuple, df.collect())) == [("1.10", "2", ""), ("q", "x", "y")]
    typed = readers.apply_mappers(df, {"a": "double", "b": "int"}, keep_raw=True).orderBy("a_raw").collect()
    assert [(r["a"], r["a_raw"], r["b"]) for r in typed] == [(1.1, "1.10", 2), (None, "q", None)]
    writers.write_delimited(df, str(tmp_path / "out"), ["b", "a"])
    assert "2\t1.10" in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    (tmp_path / "u.txt").write_text("a\ta\n1\t2\n")
    with pytest.raises(ValueError):
        readers.read_delimited(spark, str(tmp_path / "u.txt"))
    assert readers.read_delimited(spark, str(tmp_path / "u.txt"), allow_repeats=True).columns == ["a", "a_2"]


def test_region_scores_last_wins(spark, tmp_path):
    (tmp_path / "s.out").write_text("c:1-9\t+\tscore(decibans)\t5.0\t0.5\nc:1-9\t+\tscore(decibans)\t7.0\t0.6\nc:3-11\t-\tfailure\n")
    rows = {(r["start"], r["strand"]): (r["status"], r["raw"]) for r in readers.read_region_scores(spark, str(tmp_path / "s.out")).collect()}
    assert rows == {(1, "+"): ("score(decibans)", 7.0), (3, "-"): ("failure", None)}


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a\nACGT\n\nAC\n>b\nTTT\n")
    rows = readers.read_fasta(spark, str(tmp_path / "x.fa")).orderBy("name", "offset").collect()
    assert [tuple(r) for r in rows] == [("a", 0, "ACGT"), ("a", 4, "AC"), ("b", 0, "TTT")]
    df = spark.createDataFrame([("s", "A" * 7), ("e", "")], "name string, seq string")
    got = [r["value"] for r in writers.to_fasta_lines(df.filter("name = 's'"), 3).orderBy("line_no").collect()]
    assert got == [">s", "AAA", "AAA", "A"]


def test_csv_and_coefficients(spark, tmp_path):
    (tmp_path / "t.csv").write_text("k, v\n# no\na , 1\nb,2,3\n,4\n")
    rows = {r["k"]: r["v"] for r in readers.read_csv_table(spark, str(tmp_path / "t.csv"), index="k").collect()}
    assert rows == {"a": "1", "b": "2"}
    (tmp_path / "x.bin").write_bytes(struct.pack("<5d", 1, 2, 3, 4, 5))
    rows = readers.read_coefficients(spark, str(tmp_path / "x.bin"), [2, 3]).orderBy("arr", "idx").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0), (1, 2, 5.0)]
    with pytest.raises(Exception, match="instead of"):
        readers.read_coefficients(spark, str(tmp_path / "x.bin"), [2, 2]).collect()


def test_regions_are_handed_over_through_files(spark, tmp_path):
    """What write_regions() writes, read_regions() reads: the same regions, in order of starts in each file."""
    rows = [(c, s, 3 * a + f, 3 * a + f + 29, 30) for c in ("chr1", "chr2_random") for s in "+-" for f in (1, 2, 3) for a in (7, 40, 2, 1000)]
    df = spark.createDataFrame(rows, "chrom string, strand string, start long, stop long, gray long")
    folder = str(tmp_path / "out")
    writers.write_regions(df, folder)
    got = readers.read_regions(spark, folder)
    assert sorted(tuple(r) for r in got.select("chrom", "strand", "start", "stop").collect()) == sorted(r[:4] for r in rows)
    names = sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir())
    assert names == sorted(f"{c}.Strand{s}.Frame{f}.coding.bed" for c in ("chr1", "chr2_random") for s in "+-" for f in (0, 1, 2))
    one = [x for p in sorted((tmp_path / "out" / names[0]).glob("part-*")) for x in p.read_text().splitlines()]
    assert [int(x.split("\t")[1]) for x in one] == sorted(int(x.split("\t")[1]) for x in one) and len(one) == 4
    with pytest.raises(FileExistsError):
        writers.write_regions(df, folder)


def test_requests_in_order_of_records(spark, tmp_path):
    rows = [(k, f"chr{k % 3}", "+-"[k % 2], 100 + k, 129 + k) for k in range(200)]
    df = spark.createDataFrame(rows, "rank long, chrom string, strand string, start long, stop long").repartition(7)
    writers.write_requests(df, str(tmp_path / "x"), ["rank"])
    got = [r["value"] for r in readers.read_in_order(spark, str(tmp_path / "x")).orderBy("line_no").collect()]
    want = []
    for _, c, s, a, b in rows:
        want += [f"{c}:{a}-{b}\t{s}"]
        anti = df.filter(F.col("start") == a).select(scalars.anti_interval("start", "stop", "strand").alias("x")).first()["x"] if a == 100 else None
        if anti:
            assert got[1] == f"{c}:{anti['start']}-{anti['stop']}\t{anti['strand']}"
    assert got[::2] == want and len(got) == 400 and all(x.endswith("\t-" if y.endswith("+") else "\t+") for x, y in zip(got[1::2], got[::2]))
    numbers = [r["line_no"] for r in readers.read_in_order(spark, str(tmp_path / "x")).collect()]
    assert sorted(numbers) == list(range(1, 401))


def test_what_is_left_out_is_counted(spark):
    scored = spark.createDataFrame([(1.0, None), (None, None), (2.0, 0.5)], "score_per_codon double, anti_score_per_codon double")
    assert tuple(scoring.unscored(scored).first()) == (3, 1, 2)
    lines = ["c1\t10\t30\tx\t0\t+\t10\t30\t0\t2\t5,5\t0,15", "c3\t1\t9\ty\t0\t+\t1\t1\t0\t1\t8\t0"]
    bed = readers.parse_bed(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert tuple(transcripts.left_out(transcripts.transcripts_from_bed(bed)).first()) == (2, 1)
