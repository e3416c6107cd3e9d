"""From codon score files and BED files to the ranked table, every step handing over through files."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from codonweave.operators import hmm, regions, scoring, transcripts
from codonweave.session import materialize
from codonweave.sources import readers, writers


def test_from_files_to_the_ranked_table(spark, tmp_path):
    rng = random.Random(21)
    codons, coding, spans = [], [], {}
    for i in range(150):
        start, n = 3000 * i + 601, rng.randrange(15, 40)
        stop = start + 3 * n - 1
        spans[start, stop] = i
        for k in range(-50, n + 50):
            a = start + 3 * k
            codons.append(f"c:{a}-{a + 2}\t+\tscore(decibans)\t{15.0 if 0 <= k < n else -15.0}\t0.9")
        if i % 3 == 0:  # a transcript in the region's frame, its stop codon behind it
            lo, hi, strand = start - 1, stop + 3, "+"
        elif i % 3 == 1:  # one in the antisense frame
            lo, hi, strand = start + 1 - 3, stop + 2, "-"
        else:
            continue
        coding.append(f"c\t{lo}\t{hi}\tsame name\t0\t{strand}\t{lo}\t{hi}\t0\t1\t{hi - lo}\t0")
    (tmp_path / "c.Strand+.Frame1.fixed.out").write_text("\n".join(codons) + "\n")
    (tmp_path / "coding.bed").write_text("# transcripts\n" + "\n".join(coding) + "\n")
    (tmp_path / "pseudo.bed").write_text("other\t10\t40\tp\t0\t+\t10\t10\t0\t1\t30\t0\n")

    # codon scores to region files
    found = hmm.coding_regions(readers.read_codon_scores(spark, str(tmp_path / "*.fixed.out")))
    writers.write_regions(found, str(tmp_path / "regions"))
    read = readers.read_regions(spark, str(tmp_path / "regions"))
    assert {(r["start"], r["stop"]) for r in read.collect()} == set(spans)

    # regions and transcripts to classes and requests, in the order of the table
    known, pseudo = (materialize(transcripts.transcripts_from_bed(readers.read_bed(spark, str(tmp_path / name)))) for name in ("coding.bed", "pseudo.bed"))
    table = materialize(regions.classify_regions(materialize(read), known, pseudo).filter("parent is null").drop("parent"))
    kinds = {spans[r["start"], r["stop"]]: r["reg_type"] for r in table.collect()}
    assert kinds == {i: ("CodingOverlap", "AntisenseOverlap", "NoOverlap")[i % 3] for i in range(150)}
    assert known.select("tr_id").distinct().count() == len(coding)
    writers.write_requests(table, str(tmp_path / "Regions.in"), ["chrom", "start"])

    # an outside scorer answers line by line
    asked = [r["value"].split("\t") for r in readers.read_in_order(spark, str(tmp_path / "Regions.in")).orderBy("line_no").collect()]
    assert len(asked) == 300 and [a[1] for a in asked[:4]] == ["+", "-", "+", "-"]
    answers = []
    for k, (region, strand) in enumerate(asked):
        i = k // 2
        good = i % 3 == 0 or i % 30 == 2
        per = rng.gauss(8, 1) if (good if strand == "+" else i % 3 == 1) else rng.gauss(-4, 1)
        a, b = map(int, region.split(":")[1].split("-"))
        answers.append(f"{region}\t{strand}\tscore(decibans)\t{per * (b - a + 1) / 3}\t0.8")
    (tmp_path / "Regions.out").write_text("\n".join(answers) + "\n")

    # scores to candidates, best first, and their BED lines
    scores = materialize(readers.read_region_scores(spark, str(tmp_path / "Regions.out")))
    assert scoring.unscored(scoring.add_score_fields(table, scores)).first()["without_score"] == 0
    ranked = materialize(scoring.candidate_regions(table, scores, 40))
    best = [(r["rank"], spans[r["start"], r["stop"]]) for r in ranked.orderBy("rank").collect()]
    planted = {i for i in range(150) if i % 30 == 2}
    assert [k for k, _ in best] == list(range(1, len(best) + 1)) and {i for _, i in best[: len(planted)]} == planted
    lines = writers.to_bed12(scoring.candidates_bed(ranked, len(best)).withColumn("score", F.col("score").cast("string")))
    writers.write_lines(lines, str(tmp_path / "final.bed"))
    assert readers.read_bed(spark, str(tmp_path / "final.bed")).count() == len(best)
