"""Genomics operators on small models with known values, and against brute force."""

import gzip
import math
import random
import struct
import time
import zlib

import pytest
from pyspark.sql import functions as F

from strandloom.functions import reads as R
from strandloom.functions import seq as S
from strandloom.operators import intervals as I
from strandloom.plans import annotate as A
from strandloom.plans import group as G
from strandloom.plans import liftover as L
from strandloom.plans import metagene as M
from strandloom.plans import motifs as O
from strandloom.plans import qc as Q
from strandloom.plans import queries as Q_
from strandloom.plans import reference as E
from strandloom.plans import refine as N
from strandloom.sources import gtf, reads, tables

# The genome and gene models whose results are known.
GENOME = "ATGCTAGCTAG" * 30


def line(feature, start, end, strand, gene, tx, more=""):
    return "\t".join(["chr1", "src", feature, str(start), str(end), ".", strand, ".", f'gene_id "{gene}"; transcript_id "{tx}"; {more}'])


GTF = [
    "# comment",
    line("exon", 11, 30, "+", "g1", "t1", 'exon_number "1"; tag "Ensembl_canonical";'), line("exon", 51, 70, "+", "g1", "t1", 'exon_number "2"; tag "Ensembl_canonical";'), line("start_codon", 20, 22, "+", "g1", "t1"), line("stop_codon", 62, 64, "+", "g1", "t1"),
    line("exon", 121, 150, "-", "g2", "t2", 'exon_number "1"; transcript_support_level "2 (assigned)";'), line("start_codon", 137, 139, "-", "g2", "t2"), line("stop_codon", 128, 130, "-", "g2", "t2"),
    line("exon", 201, 215, "+", "g3", "t3", 'exon_number "1"; transcript_support_level "NA";'), "broken\tline",
]


@pytest.fixture(scope="module")
def exons(spark):
    return E.exon_reference(gtf.parse_lines(spark.createDataFrame([(x,) for x in GTF], "value string"))).cache()


@pytest.fixture(scope="module")
def sequences(spark, exons):
    chunks = tables.chunked(spark.createDataFrame([("chr1", 0, GENOME)], "chrom string, at long, seq string"), 64)
    spans = exons.select("gene_id", "transcript_id", "strand", "start_offset", "chrom", "e_start", "e_end", F.concat_ws("/", "transcript_id", "e_start").alias("r"))
    return A.spliced(exons, tables.fetch(chunks, spans, "r", "e_start", "e_end", 64)).cache()


def variants(spark, data):
    return spark.createDataFrame([(i, "chr1", str(p), s, r, a) for i, (p, s, r, a) in enumerate(data)], "site_id long, chrom string, pos string, strand string, ref string, alt string")


def test_exon_reference(exons, rows):
    got = rows(exons, "transcript_id", "e_start", "e_end", "start_offset", "end_offset", "transcript_length", "transcript_level", "start_codon_pos", "stop_codon_pos")
    assert got == [("t1", 10, 30, 0, 20, 40, 0, 9, 31), ("t1", 50, 70, 20, 40, 40, 0, 9, 31), ("t2", 120, 150, 0, 30, 30, 2, 11, 20), ("t3", 200, 215, 0, 15, 15, 6, None, None)]
    assert E.broken(exons).count() == 0


def test_annotate(spark, exons, sequences):
    plus = [(13, "FivePrimeUTR", 2), (26, "CDS", 15), (66, "ThreePrimeUTR", 35), (41, "Intronic", None), (6, "Intergenic", None), (141, "FivePrimeUTR", 9), (133, "CDS", 17), (125, "ThreePrimeUTR", 25), (211, "NoncodingTranscript", 10)]
    got = {r["site_id"]: r for r in A.annotate(variants(spark, [(p, "+", "C", "G") for p, *_ in plus]), exons).collect()}
    assert [(got[i]["region"], got[i]["transcript_pos"]) for i in range(len(plus))] == [x[1:] for x in plus]
    assert got[1]["mut_type"] == "CDS" and got[3]["mut_type"] == "Intronic" and got[4]["gene_id"] is None and got[1]["gene_pos"] == 24
    r = A.annotate(variants(spark, [(26, "+", "C", "G"), ("x", "+", "C", "G")]), exons, sequences).collect()
    assert len(r) == 1 and r[0]["codon_ref"] == GENOME[25:28] and len(r[0]["transcript_motif"]) == 21 and r[0]["coding_pos"] == 6 and r[0]["aa_pos"] == 3
    effects = A.as_effects(A.annotate(variants(spark, [(41, "+", "C", "G"), (26, "+", "C", "G")]), exons, exon_only=True))
    assert set(A.EFFECT_COLUMNS) <= set(effects.columns) and effects.count() == 1 and effects.first()["mut_type"] == "IncompleteTranscript"


def test_splice_distance(spark, exons):
    got = {r["site_id"]: r["distance2splice"] for r in A.annotate(variants(spark, [(26, "+", "C", "G"), (53, "+", "C", "G"), (133, "-", "C", "G")]), exons).collect()}
    assert got == {0: 25 - 30, 1: 52 - 50, 2: None}


def test_effects(spark):
    rows = [("TGG", "G", "A", 2, "PrematureStop"), ("GCA", "A", "T", 2, "Silent"), ("GCA", "G", "A", 0, "Substitution"), ("GC", "G", "A", 0, "CDS"), ("GCA", "GC", "AA", 0, "ComplexSubstitution"), ("GCA", "GCAT", "G", 0, "InFrameIndel"), ("GCA", "GC", "G", 0, "FrameShift")]
    df = spark.createDataFrame(rows, "c string, r string, a string, o int, w string")
    assert df.select((A.effect(F.col("c"), F.col("r"), F.col("a"), F.col("o")) == F.col("w")).alias("ok")).where("not ok").count() == 0


def test_table_mode(spark):
    table = spark.createDataFrame([("g", "t", "chr1", "+", "100-109,150-159"), ("h", "u", "chr1", "-", "150-159,100-109"), ("n", None, "chr1", "+", None)], "gene_id string, transcript_id string, chrom string, strand string, spans string")
    e = tables.annotation_exons(table)
    hit = A.annotate_table(variants(spark, [(105, "+", "", ""), (152, "-", "", ""), (99, "+", "", "")]), e)
    assert {(r["site_id"], r["transcript_id"], r["transcript_pos"]) for r in hit.collect()} == {(0, "t", "5"), (1, "u", "7"), (2, ".", ".")}
    assert {(r["site_id"], r["hits"]) for r in A.collapse(hit, True).collect()} == {(0, 1), (1, 1), (2, 0)}


def test_overlaps_brute(spark, rows):
    r = random.Random(7)
    span = lambda: (s := r.randint(0, 3_000_000), s + r.choice([0, 1, 50, 2000, 70_000, 900_000]))
    left = [(i, r.choice("ab"), *span()) for i in range(120)] + [(900, None, 1, 5), (901, "a", None, 5)]
    right = [(i, r.choice("ab"), *span()) for i in range(120)] + [(900, None, 1, 5)]
    a = spark.createDataFrame(left, "l long, k string, ls long, le long")
    b = spark.createDataFrame(right, "r long, k string, rs long, re long")
    want = sorted((x[0], y[0]) for x in left for y in right if x[1] and x[1] == y[1] and None not in x and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3])
    assert rows(I.overlap_pairs(a, b, ["k"], ("ls", "le"), ("rs", "re"), ["l"]), "l", "r") == want
    points = sorted((x[0], y[0]) for x in left for y in right if x[1] and x[1] == y[1] and x[2] is not None and y[2] <= x[2] < y[3])
    assert rows(I.overlap_pairs(a.drop("le"), b, ["k"], ("ls", None), ("rs", "re"), ["l"]), "l", "r") == points
    assert I.overlap_join(a, b, ["k"], ("ls", "le"), ("rs", "re"), "l", "left").select("l").distinct().count() == len(left)
    assert rows(I.overlap_pairs(a, b.limit(0), ["k"], ("ls", "le"), ("rs", "re"), ["l"]), "l") == []
    with pytest.raises(ValueError):
        I.overlap_pairs(a.withColumn("rs", F.lit(1)), b, ["k"], ("ls", "le"), ("rs", "re"), ["l"])


def test_map_to_local(spark):
    q = [(0, "c", 100, 110, "+", "r1"), (1, "c", 150, 160, "+", "r1"), (2, "d", 100, 110, "+", "r2"), (3, "e", 100, 110, "+", "r3"), (4, "e", 250, 260, "-", "r3"), (5, "e", 450, 460, "+", "r3"), (6, "z", 1, 2, "+", "r")]
    r = [("r1", "c", 90, 300, "+"), ("r2", "d", 90, 300, "-"), ("r3", "e", 90, 200, "+"), ("r3", "e", 240, 500, "+")]
    got = M.map_to_local(spark.createDataFrame(q, "id int, chrom string, start long, end long, strand string, w string"), spark.createDataFrame(r, "ref string, chrom string, r_start long, r_end long, r_strand string"), "ref", "id")
    assert {x["id"]: (x["local_start"], x["local_end"], x["local_strand"]) for x in got.collect()} == {0: (10, 20, "+"), 1: (60, 70, "+"), 2: (190, 200, "-"), 3: (10, 20, "+"), 4: (120, 130, "-"), 5: (320, 330, "+")}


def test_metagene(spark, exons):
    sites = tables.sites(tables.with_record_id(spark.createDataFrame([("chr1", "26", "+", "2"), ("chr1", "66", "+", "3"), ("chr1", "x", "+", "1"), ("chr9", "1", "+", "1")], "c string, p string, s string, w string")), (0, 1, 2))
    p = M.metagene(sites, exons, 10, weight=["w"])
    assert p.agg(F.sum("count_w")).first()[0] == 5.0
    assert M.metagene(sites, exons, 10, weight=["w"], only="CDS").agg(F.sum("count_w")).first()[0] == 2.0
    assert M.region_edges((0.0, 0.0, 0.0), 4) == [0, 0.25, 0.5, 0.75, 1.0] and M.region_edges((0.25, 0.5, 0.25), 4) == [0, 0.25, 0.5, 0.75, 1.0]
    point, lost = M.metagene_point(sites, exons, "start_codon", 10, 10, 4)
    assert lost == 1 and point.agg(F.sum("count")).first()[0] == 1.0
    h = M.histogram(spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.1,), (None,)], "x double"), "x", [0, 0.5, 1.0])
    assert [r["count"] for r in h.orderBy("bin").collect()] == [1.0, 2.0]
    with pytest.raises(ValueError):
        M.gene_splits(sites, "mode")


def test_bins_and_edges(spark):
    df = spark.createDataFrame([(0.1, 1), (0.5, 2), (0.9, 3), (1.0, 1), (1.5, 9)], "x double, w int")
    r = M.bin_statistics(df, "x", "w", 10).orderBy("bin").collect()
    assert sum(x["count"] for x in r) == 4 and r[9]["sum"] == 4 and r[9]["mean"] == 2
    w = M.weights(spark.createDataFrame([("0", 2), ("8", 2), ("x", 2), ("-1", 2)], "w string, transcript_length int"), "w", True, "log2").collect()
    assert w[0]["w"] == -math.inf and w[1]["w"] == 2 and w[2]["w"] is None and math.isnan(w[3]["w"])


def test_nearest_and_merge(spark, rows):
    df = spark.createDataFrame([([10, 20], 15), ([10, 20], 16), ([10], 5), ([], 5), ([10, 20], 25)], "a array<int>, x int")
    assert [r[0] for r in df.select(I.nearest_in(F.col("a"), F.col("x"))).collect()] == [10, 20, 10, None, 20]
    m = spark.createDataFrame([("a", 1, 5), ("a", 5, 7), ("a", 9, 9), ("a", 8, 10), ("b", 1, 2)], "k string, s long, e long")
    assert rows(I.merge_intervals(m, ["k"], "s", "e")) == [("a", 1, 7), ("a", 8, 10), ("b", 1, 2)]
    assert rows(I.merge_intervals(m, ["k"], "s", "e", 1)) == [("a", 1, 10), ("b", 1, 2)]
    assert rows(I.depth_steps(m, ["k"], "s", "e")) == [("a", 1, 5, 1), ("a", 5, 7, 1), ("a", 8, 10, 1), ("b", 1, 2, 1)]


def test_sequences(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(S.reverse_complement(F.lit("ACGTNacgtu"))) == "uacgtNACGT"
    assert one(S.reverse_base(F.lit("ACRN"))) == "NYGT" and one(S.reverse_base(F.lit("acR"))) == "Rca"
    assert one(S.expand_base(F.lit("n"))) == ["G", "A", "T", "C"] and one(S.expand_base(F.lit("?"))) is None
    assert one(S.convert_bases(F.lit("aTt"), "T", "U")) == "aUu" and one(S.convert_bases(F.lit(">Tt"), "T", "U")) == ">Tt"
    assert one(S.protein_text(F.lit("ATGTAAGCC"))) == "MSTOPA" and one(S.translate_codon(F.lit("atg"))) == "M"
    assert one(S.padded_motif(F.lit("ACGT"), F.lit(0), 2)) == "NNACG" and one(S.mark_site(F.lit("AACGG"), F.lit("+"), 1, 3)) == "A[A]CGG" and one(S.mark_site(F.lit("AACGG"), F.lit("-"), 1, 3)) == "AAC[G]G"


def test_protein_whole_text(spark, tmp_path):
    texts = ["ab", "abc", "The quick brown fox! " * 40, None, "x" * 5000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for i, text in enumerate(texts):
        s = "".join("ACGT"[(ord(a) - 97) % 4] for a in (text or "").lower() if "a" <= a <= "z")
        if len(s) >= 3:
            want[i] = "".join(S.codons()[s[k : k + 3].replace("T", "U")] for k in range(0, len(s) // 3 * 3, 3))
    assert {r["doc_id"]: r["protein"] for r in Q_.QUERIES["h17_protein"](spark, str(tmp_path)).collect()} == want
    one = lambda x: spark.range(1).select(S.protein_text(F.lit(x))).first()[0]
    assert one("") == "" and one("AT") == "" and one("ATGN\nCAT") == "MX" and one("augtaa") == "MSTOP"


def test_motifs(spark):
    chunks = tables.chunked(spark.createDataFrame([("chr1", 0, GENOME)], "chrom string, at long, seq string"), 50)
    lengths = spark.createDataFrame([("chr1", len(GENOME))], "chrom string, length long")
    r = random.Random(5)
    sites = [(i, "chr1", str(r.choice([1, 3, 150, 329, 330, r.randint(1, 330), 400, 0])), r.choice("+-")) for i in range(60)]
    got = {x["id"]: x["motif"] for x in O.site_motifs(spark.createDataFrame(sites, "id int, chrom string, pos string, strand string"), chunks, lengths, "id", 10, 4, 50).collect()}
    swap = str.maketrans("ACGT", "TGCA")
    for i, _, pos, strand in sites:
        p = int(pos) - 1
        base = lambda k: GENOME[k] if 0 <= k < len(GENOME) else "N"
        want = "".join(base(k) for k in range(p - 10, p + 5)) if strand == "+" else "".join(base(k) for k in range(p + 4, p - 11, -1)).translate(swap)
        assert got[i] == want
    own = tables.chunked(spark.createDataFrame([("c", 0, "AACCCGGGGGTTTTTT")], "chrom string, at long, seq string"), 50)
    marked = O.site_motifs(spark.createDataFrame([(1, "c", "8", "-"), (2, "c", "8", "+")], "id int, chrom string, pos string, strand string"), own, spark.createDataFrame([("c", 16)], "chrom string, length long"), "id", 4, 1, 50, wrap=True)
    assert {x["id"]: x["motif"] for x in marked.collect()} == {1: "C[C]CCGG", 2: "CCGG[G]G"}
    for wrong in ("x", "-20", "+5", "1.0", None):
        with pytest.raises(ValueError):
            O.site_motifs(spark.createDataFrame([(1, "chr1", wrong, "+")], "id int, chrom string, pos string, strand string"), chunks, lengths, "id", 1, 1, 50)
    with pytest.raises(ValueError):
        O.site_motifs(spark.createDataFrame([(1, "chr1", "5", "*")], "id int, chrom string, pos string, strand string"), chunks, lengths, "id", 1, 1, 50)


def test_logo(spark):
    m = spark.createDataFrame([(0, "ACT", 3.0), (1, "ACG", 1.0), (2, "GCG", None)], "idx long, motif string, weight double")
    got = {(r["position"], r["base"]): (r["score"], r["rank"]) for r in O.motif_scores(m).collect()}
    assert got[0, "A"] == (4.0, 1) and got[0, "G"] == (0.0, 2) and got[2, "U"] == (3.0, 1)
    same = spark.createDataFrame([(0, "A", 1.0), (1, "A", 1.0)], "idx long, motif string, weight double")
    assert O.motif_scores(same).first()["score"] == 0.0
    bits = O.motif_scores(spark.createDataFrame([(0, "A", 1.0), (1, "A", 0.0)], "idx long, motif string, weight double"), bits=True).first()["score"]
    assert bits == pytest.approx((2 + 0.5 * math.log2(0.5)) / 2)
    assert O.score_matrix(O.motif_scores(m)).orderBy("position").first()["A"] == 4.0
    with pytest.raises(ValueError):
        O.motif_scores(spark.createDataFrame([(0, "A", 1.0), (1, "AC", 1.0)], "idx long, motif string, weight double"))


def test_read_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(R.flip_flag(F.lit(99))) == 99 ^ 48 and one(R.flip_flag(F.lit(0))) == 16
    assert [tuple(b) for b in one(R.reference_blocks(F.lit("5S10M2I3D5=10N1X4H"), F.lit(100)))] == [(100, 110), (113, 118), (128, 129)]
    assert one(R.reverse_cigar(F.lit("5M3D2S"))) == "2S3D5M" and one(R.query_length(F.lit("5M3D2S1I"))) == 8
    assert R.reversed_md("10A5^AC6") == "6^GT5T10" and R.reversed_md("0A0") == "0T0" and R.reversed_md("") == "" and R.reversed_md(R.reversed_md("3C0G2^T4")) == "3C0G2^T4"
    assert R.score_read("5M", "ACTTA", "ACCTA", True) == (5, 0, "2C2", 0, 2, 1, 1, 0, 0)
    assert R.score_read("2M1I2M", "ACGTA", "ACTA", True)[0] == 3 and R.score_read("2M", "A", "AC", True)[0] == -999
    assert [r[0] for r in spark.createDataFrame([("10A5",), (None,)], "md string").select(R.reverse_md("md")).collect()] == ["5T10", None]


def read(pos, cigar, seq, **more):
    return {"flag": 0, "pos": pos, "cigar": cigar, "seq": seq, "qual": "I" * len(seq), "md": None} | more


def test_liftover_reads():
    exons = [(10, 30), (50, 70)]
    assert L.to_genome(read(2, "10M", "A" * 10), exons, "+")["pos"] == 12
    got = L.to_genome(read(18, "4M2D4M", "ACGTACGT"), exons, "-")
    assert (got["pos"], got["cigar"], got["flag"], got["seq"]) == (22, "4M2D2M20N2M", 16, "ACGTACGT")
    assert L.to_genome(read(35, "10M", "A" * 10), exons, "+") is None
    assert L.to_transcript(read(12, "5M", "ACGTA"), exons, "+")["pos"] == 2
    clipped = L.to_transcript(read(26, "10M", "ACGTACGTAC"), exons, "+")
    assert clipped["cigar"] == "4M6S" and clipped["pos"] == 16
    assert L.to_transcript(read(26, "10M", "ACGT"), exons, "+") is None and L.to_transcript(read(28, "4M1D4M", "ACGTACGT"), exons, "+") is None
    r = random.Random(9)
    for _ in range(500):
        strand, n = r.choice("+-"), r.randint(1, 20)
        start = r.randint(0, 40 - n)
        there = L.to_genome(read(start, f"{n}M", "".join(r.choices("ACGT", k=n))), exons, strand)
        back = L.to_transcript(there, exons, strand)
        assert back["pos"] == start and back["cigar"] == f"{n}M" and back["flag"] == 0


def test_lift_frame(spark, exons):
    tx = A.transcripts(exons).withColumn("ord", F.monotonically_increasing_id())
    sam = ["@HD\tVN:1.6", "a\t0\tt1\t3\t60\t30M\t*\t0\t0\t" + "A" * 30 + "\t" + "I" * 30 + "\tNM:i:0\tSA:Z:x", "b\t0\tnone\t3\t60\t5M\t*\t0\t0\tAAAAA\tIIIII", "c\t99\tg2\t1\t60\t5M\t=\t11\t20\tACGTA\tIIIII\tMD:Z:2C2"]
    parsed = reads.parse_sam(spark.createDataFrame(list(enumerate(sam)), "ord long, value string"))
    got = {r["qname"]: r for r in L.lift_reads(parsed, tx).collect()}
    assert got["a"]["rname"] == "chr1" and got["a"]["cigar"] == "18M20N12M" and got["a"]["pos"] == 12 and "SA" not in got["a"]["tags"]
    assert got["b"]["demoted"] and got["b"]["rname"] == "none"
    assert got["c"]["pos"] == 145 and got["c"]["flag"] == 99 ^ 48 and got["c"]["tags"]["MD"] == "Z:2G2" and got["c"]["rnext"] == "="
    lines = [r["value"] for r in reads.sam_lines(parsed).orderBy("ord").collect()]
    assert lines[0].split("\t")[:6] == sam[1].split("\t")[:6]


def per_base(read, exons, strand):
    """to_transcript base by base."""
    at, n = {}, 0
    for s, e in sorted(exons):
        for g in range(s, e):
            at[g], n = n, n + 1
    ops = L.parse_cigar(read["cigar"])
    deleted = any(op == "D" for op, _ in ops)
    g, events = read["pos"], []
    for op, k in ops:
        if op in "M=XD":
            for x in range(g, g + k):
                t = at.get(x)
                if t is None and deleted:
                    return None
                events.append(("S", None) if t is None else ("D" if op == "D" else "M", n - 1 - t if strand == "-" else t))
            g += k
        elif op == "N":
            g += k
        elif deleted and op == "I":
            return None
        else:
            events += [(op, None)] * k
    events = events[::-1] if strand == "-" else events
    made, last = [], None
    for op, t in events:
        if t is not None:
            if last is not None:
                if t <= last:
                    return None
                made.append(("N", t - last - 1))
            last = t
        made.append((op, 1))
    placed = [t for _, t in events if t is not None]
    if not placed or sum(k for op, k in made if op in "MIS=X") != len(read["seq"]):
        return None
    return placed[0], L.format_cigar(made)


def test_to_transcript_brute():
    r = random.Random(21)
    done = 0
    for _ in range(4000):
        cuts = sorted(r.sample(range(100), 2 * r.randint(1, 4)))
        exons, strand = list(zip(cuts[::2], cuts[1::2])), r.choice("+-")
        cigar = "".join(f"{r.randint(1, 12)}{op}" for op in r.choice(["M", "MNM", "SMS", "MIM", "MDM", "MNMNM", "M=XM", "MNMDM"]))
        x = read(r.randint(0, 95), cigar, "A" * sum(n for op, n in L.parse_cigar(cigar) if op in "MIS=X"))
        got = L.to_transcript(x, exons, strand)
        assert (got and (got["pos"], got["cigar"])) == per_base(x, exons, strand), (x, exons, strand)
        done += got is not None
    assert done > 500


def test_mates_on_transcripts(spark, exons):
    assert L.mate_on_transcript(55, 5, [(10, 30), (50, 70)], "+") == 25 and L.mate_on_transcript(40, 5, [(10, 30), (50, 70)], "+") is None
    assert L.mate_on_transcript(130, 5, [(120, 150)], "-") == 15 and L.mate_on_transcript(149, 5, [(120, 150)], "-") == 0
    tx = A.transcripts(exons)
    sam = ["a\t99\tchr1\t13\t60\t5M\t=\t56\t48\tACGTA\tIIIII", "b\t99\tchr1\t13\t60\t5M\t=\t41\t33\tACGTA\tIIIII", "c\t99\tchr1\t13\t60\t5M\tchr2\t56\t0\tACGTA\tIIIII", "d\t0\tchr1\t13\t60\t5M\t*\t0\t0\tACGTA\tIIIII"]
    parsed = reads.parse_sam(spark.createDataFrame(list(enumerate(sam)), "ord long, value string")).withColumn("transcript_id", F.lit("t1"))
    got = {r["qname"]: (r["rname"], r["pos"], r["rnext"], r["pnext"]) for r in L.lift_reads(parsed, tx, "transcript").collect()}
    assert got == {"a": ("t1", 2, "=", 25), "b": ("t1", 2, "*", -1), "c": ("t1", 2, "*", -1), "d": ("t1", 2, "*", -1)}


def test_inflate_many_blocks():
    """A BGZF file of many blocks, each with its size in the header."""
    r = random.Random(6)
    parts = [r.randbytes(r.randint(0, 3000)) for _ in range(400)]
    data = b""
    for x in parts:
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(x) + c.flush()
        data += struct.pack("<BBBBIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(x), len(x))
    assert b"".join(reads._inflate(data)) == b"".join(parts) and b"".join(reads._inflate(data + gzip.compress(b"end"))) == b"".join(parts) + b"end"


def test_bam(spark, tmp_path):
    name, seq = b"r1\0", "ACGTN"
    packed = bytes((("=ACMGRSVTWYHKDBN".index(a) << 4) | "=ACMGRSVTWYHKDBN".index(b)) for a, b in zip("ACG", "CGT"))
    packed = bytes([0x12, 0x48, 0xF0])
    body = struct.pack("<iiBBHHHiiii", 0, 99, len(name), 60, 0, 1, 16, len(seq), -1, -1, 0) + name + struct.pack("<I", 5 << 4) + packed + bytes([40] * 5) + b"NMC\x02" + b"MDZ3A1\0"
    raw = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 330) + struct.pack("<i", len(body)) + body
    half = len(raw) // 2
    path = tmp_path / "x.bam"
    path.write_bytes(gzip.compress(raw[:half]) + gzip.compress(raw[half:]))
    r = reads.read_bam(spark, str(path)).collect()
    assert len(r) == 1 and (r[0]["qname"], r[0]["pos"], r[0]["cigar"], r[0]["seq"], r[0]["rname"]) == ("r1", 99, "5M", "ACGTN", "chr1") and r[0]["tags"] == {"NM": "i:2", "MD": "Z:3A1"}
    with pytest.raises(ValueError):
        reads.read_bam(spark, "x.cram")
    assert zlib.decompressobj(31)


def test_table_liftover(spark, exons):
    tx = A.transcripts(exons).withColumn("ord", F.col("transcript_id"))
    rows = spark.createDataFrame([(0, "g1", "3"), (1, "g1", "21"), (2, "g2", "1"), (3, "g1", "99"), (4, "nope", "1"), (5, "g1", "x"), (6, "g1", "1.9"), (7, "g1", None)], "id int, gene_id string, tx_pos string")
    got = {r["id"]: (r["chrom"], r["pos"]) for r in L.table_to_genome(rows, tx, "id").collect()}
    assert got == {0: ("chr1", 13), 1: ("chr1", 51), 2: ("chr1", 150), 3: (None, None), 4: (None, None), 5: (None, None), 6: ("chr1", 11), 7: (None, None)}
    e = exons.select("chrom", "strand", "e_start", "e_end", F.col("start_offset").alias("offset"), "gene_id", "transcript_id", F.col("transcript_id").alias("ord"), F.col("start_offset").alias("exon_no"))
    back = {r["id"]: r["tx_pos"] for r in L.table_to_transcript(spark.createDataFrame([(0, "chr1", "13"), (1, "chr1", "150"), (2, "chr1", "40")], "id int, chrom string, pos string"), e, "id").collect()}
    assert back == {0: 3, 1: 1, 2: None}


def test_registered_liftover_keeps_ambiguous_transcripts(spark, tmp_path):
    # T1 has rows that disagree on the chromosome, T2 is listed under two genes
    ref = [("c1", 100, 200, "+", "GA", "T1"), ("c2", 500, 550, "+", "GA", "T1"), ("c1", 300, 400, "-", "GB", "T2"), ("c1", 300, 400, "-", "GC", "T2")]
    spark.createDataFrame([(*x, 1, 0, 30, "n", "b") for x in ref], "chromosome string, start long, end long, strand string, gene_id string, transcript_id string, transcript_level long, start_codon_pos int, stop_codon_pos int, gene_name string, gene_biotype string").write.parquet(str(tmp_path / "exon_ref.parquet"))
    ann = [(1, "GA", "T1", 5), (2, "GB", "T2", 5), (3, "GA", "T9", 5), (3, "GA", "T1", 7)]
    spark.createDataFrame([(*x, "A" * 21, "r") for x in ann], "annotation_id long, gene_id string, transcript_id string, transcript_pos long, transcript_motif string, region string").write.parquet(str(tmp_path / "annotation.parquet"))
    got = {n: {r[0]: tuple(r)[1:] for r in Q_.QUERIES[n](spark, str(tmp_path)).collect()} for n in ("i1_to_genome", "i2_to_transcript", "c10_tx_to_genome")}
    assert got["i1_to_genome"] == {"r1": (0, "c1", 105, "21M", False), "r2": (16, "c1", 374, "21M", False), "r3": (0, "c1", 107, "21M", False)}
    assert {k: v[1:] for k, v in got["i2_to_transcript"].items()} == {"r1": ("T1", 5, "21M"), "r2": ("T2", 5, "21M"), "r3": ("T1", 7, "21M")}
    assert got["c10_tx_to_genome"] == {1: ("c1", 105), 2: ("c1", 396), 3: ("c1", 105)}


QC_GTF = [(0, "gene", 100, 400, "+", "G1"), (1, "exon", 100, 200, "+", "G1"), (2, "exon", 300, 400, "+", "G1"), (3, "gene", 500, 600, "-", "G2"), (4, "exon", 500, 600, "-", "G2")]


def test_hits_go_on_narrow(spark):
    """Neither exons nor sequences are shuffled with the sites, though codons, motifs and amino acids are those of the text."""
    exons = E.with_offsets(spark.createDataFrame([("G", "T", "c", "+", 100, 110, 3, 12), ("G", "T", "c", "+", 200, 220, 3, 12), ("H", "U", "c", "-", 205, 215, None, None)], "gene_id string, transcript_id string, chrom string, strand string, e_start long, e_end long, start_codon_pos long, stop_codon_pos long"))
    texts = spark.createDataFrame([("G", "T", "AAATGACGTTGGTAACCCCCCCCCCCCCCC")], "gene_id string, transcript_id string, spliced string")
    sites = spark.createDataFrame([(1, "c", 108, "+", "T", "C"), (2, "c", 150, "+", "A", "C"), (3, "c", 999, "+", "A", "C"), (4, None, 108, "+", "A", "C"), (5, "c", 207, "+", "A", "C")], "site_id long, chrom string, pos long, strand string, ref string, alt string")
    out = A.annotate(sites, exons, texts)
    plan, wide = out._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.initialPlan())
        if node.nodeName() == "Exchange":
            names = [node.output().apply(i).name() for i in range(node.output().size())]
            wide.extend([names] if "site_id" in names and {"exons", "spliced", "_cds"} & set(names) else [])
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    assert wide == []
    got = {r["site_id"]: r for r in out.collect()}
    assert [got[k]["region"] for k in range(1, 6)] == ["CDS", "Intronic", "Intergenic", "Intergenic", "ThreePrimeUTR"]
    # TGA CGT TGG TAA from 3 on: position 7 is the second base of CGT; the stop before it takes four letters, so the second letter is T
    r = got[1]
    assert (r["transcript_pos"], r["coding_pos"], r["codon_ref"], r["aa_pos"], r["aa_ref"], r["mut_type"], r["transcript_motif"]) == (7, 4, "CGT", 2, "T", "Substitution", "NNNAAATGACGTTGGTAACCC")
    assert got[4]["chrom"] is None and got[3]["gene_id"] is None and got[5]["mut_type"] == "ThreePrimeUTR"


def test_qc(spark):
    rows = spark.createDataFrame([(o, f, "chr1", a, b, s, g, g, "protein_coding") for o, f, a, b, s, g in QC_GTF], "ord long, feature string, chrom string, start long, end long, strand string, gene_id string, gene_name string, gene_biotype string")
    r = lambda i, pos, cigar, flag=0: (i, f"q{i}", flag, "chr1", pos, 255, cigar, "*", -1, 0, "A" * 50, "I" * 50, {"NM": "i:0"})
    data = [r(0, 110, "50M"), r(1, 120, "50M", 1024), r(2, 175, "25M100N25M"), r(3, 320, "50M"), r(4, 220, "50M"), r(5, 800, "50M"), r(6, 180, "50M")]
    df = spark.createDataFrame(data, "ord long, qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string, tags map<string,string>")
    table, more = Q.metrics(df, rows, unpaired=True)
    m = {x["statistic"]: x["value"] for x in table.collect()}
    assert m["Exonic Rate"] == pytest.approx(4 / 7) and m["Intronic Rate"] == pytest.approx(1 / 7) and m["Intergenic Rate"] == pytest.approx(1 / 7) and m["Ambiguous Alignment Rate"] == pytest.approx(1 / 7)
    assert m["Unique Rate of Mapped"] == pytest.approx(6 / 7) and m["Read Length"] == 50 and m["Discard Rate"] == 0
    g = {x["gene_id"]: x for x in more["genes"].collect()}
    assert g["G1"]["reads"] == 4 and g["G1"]["tpm"] == pytest.approx(1e6) and g["G2"]["reads"] == 0
    assert more["exons"].agg(F.sum("dose")).first()[0] == pytest.approx(4.0)
    with pytest.raises(ValueError):
        Q.metrics(df.withColumn("rname", F.lit("other")), rows)


def test_bodies_are_merged_before_they_meet(spark, rows, monkeypatch):
    """A block meets as many rows as there are strands and kinds, however many gene bodies lie over it."""
    b = spark.createDataFrame([(1, 0, "c", 10, 20), (2, 0, "c", 400, 420), (2, 1, "c", 900, 950), (3, 0, "c", 2000, 2010), (4, 0, "c", 299, 301)], "read long, block_no int, chrom string, b_start long, b_end long")
    data = [("c", k, 300 - k, "+", False, f"p{k}") for k in range(50)] + [("c", 300 + k, 500, "-", False, f"m{k}") for k in range(50)] + [("c", 900, 1000, "-", True, "r"), ("c", 2010, 2020, "+", True, "s"), (None, 0, 9, "+", True, "t")]
    genes = spark.createDataFrame(data, "chrom string, g_start long, g_end long, strand string, ribosomal boolean, gene_id string")
    met = []
    real = Q.overlap_pairs
    monkeypatch.setattr(Q, "overlap_pairs", lambda left, right, *more: (met.append(right.count()), real(left, right, *more))[1])
    got = rows(Q.body_pairs(b, genes, ("strand", "ribosomal")), "read", "strand", "ribosomal")
    assert got == [(1, "+", False), (2, "-", False), (2, "-", True), (4, "+", False), (4, "-", False)]
    assert met[0] <= 5


def test_qc_pairs_and_bias(spark):
    rows = spark.createDataFrame([(0, "exon", "chr1", 1000, 2000, "+", "G3", "G3", "x")], "ord long, feature string, chrom string, start long, end long, strand string, gene_id string, gene_name string, gene_biotype string")
    data = [(i * 2 + k, f"q{i}", 99 if k == 0 else 147, "chr1", 1000 + i + k * 650, 255, "50M", "=", 0, 700 if k == 0 else -700, "A" * 50, "I" * 50, {"NM": "i:0"}) for i in range(3) for k in range(2)]
    df = spark.createDataFrame(data, "ord long, qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string, tags map<string,string>")
    _, more = Q.metrics(df, rows)
    assert [x["size"] for x in more["fragments"].collect()] == [700, 700, 700]
    covered = spark.createDataFrame([("G", 0, 1000)] * 3, "gene_id string, c_start long, c_end long")
    genes = spark.createDataFrame([("G", 1000), ("short", 100), ("none", 1000)], "gene_id string, exon_length long")
    assert [tuple(x) for x in Q.three_prime_bias(covered, genes).collect()] == [("G", 0.5)]
    x = Q.library_complexity(80, 20)
    assert abs(x * (1 - math.exp(-100 / x)) - 80) < 1 and Q.library_complexity(5, 0) == 0


def test_all_fragments_count(spark, rows):
    """Sizes beyond the first million, which are the largest, count too."""
    n = 1_000_003
    r = spark.range(2 * n).select(F.col("id").alias("read"), F.floor(F.col("id") / 2).cast("string").alias("qname"), F.when(F.col("id") < 2 * n - 6, 100).otherwise(900).cast("long").alias("tlen"), F.lit(True).alias("paired"), F.lit(True).alias("hq"))
    b = r.select("read", F.lit(0).alias("block_no"))
    got = Q.fragments(b.withColumn("full", F.lit(True)).withColumn("exon_id", F.lit("e")), b, r)
    assert rows(got.groupBy("size").count()) == [(100, 1_000_000), (900, 3)]


def test_verdicts_of_reads_in_one_pass(spark, rows):
    """Classes and marks of reads together are what classes() and marks() tell; reads without blocks are left out."""
    flags = spark.createDataFrame([(i, i % 2 == 0, i % 3 == 0, i % 5 == 0) for i in range(8)], "read long, hq boolean, first boolean, reverse boolean")
    blocks = spark.createDataFrame([(i, "c") for i in (0, 1, 1, 2, 3, 4, 5)], "read long, chrom string")
    bodies = spark.createDataFrame([(1, "+", False), (1, "-", False), (2, "-", True), (3, None, None)], "read long, strand string, ribosomal boolean")
    pairs = spark.createDataFrame([(2, "+", False), (4, "-", False), (5, "+", True)], "read long, strand string, ribosomal boolean")
    unamb = spark.createDataFrame([(5, "G"), (5, "H")], "read long, gene_id string")
    want = Q.classes(blocks, pairs, unamb, None, bodies).join(Q.marks(pairs, bodies), "read", "left").join(flags, "read").fillna(False, ["plus", "minus", "ribosomal"])
    cols = ("read", "class", "plus", "minus", "ribosomal", "hq", "first", "reverse")
    got = rows(Q.verdicts(blocks, pairs, unamb, bodies, flags), *cols)
    assert got == rows(want, *cols) and [x[1] for x in got] == ["intergenic", "intronic", "ambiguous", "intronic", "ambiguous", "exonic"]


def test_qc_all_statistics(spark):
    g = [("exon", 1000, 2000, "+", "G1", "x"), ("exon", 3000, 3100, "-", "HBB", "x"), ("gene", 5000, 5200, "+", "R", "rRNA"), ("exon", 5000, 5100, "+", "R", "rRNA")]
    rows = spark.createDataFrame([(i, f, "chr1", a, b, s, n, n, t) for i, (f, a, b, s, n, t) in enumerate(g)], "ord long, feature string, chrom string, start long, end long, strand string, gene_id string, gene_name string, gene_biotype string")
    pairs = [((1150, "100M", 2 * (i == 0)), (1750, "100M", 0), 700, 255, 0) for i in range(5)] + [((1750, "100M", 0), (1750, "100M", 0), 100, 255, 1024)]
    pairs += [((3000, "50M", 0), (3050, "50M", 0), 100, 255, 1024), ((5050, "100M", 0), (5150, "20M10N20M", 0), 150, 255, 0), ((9000, "50M", 0), (9100, "50M", 7), 150, 10, 0)]
    data = [(i * 2 + k, f"q{i}", (147 if k else 99) | dup, "chr1", x[0], mapq, x[1], "=", 0, -size if k else size, "A" * 50, "I" * 50, {"NM": f"i:{x[2]}"}) for i, (a, b, size, mapq, dup) in enumerate(pairs) for k, x in enumerate((a, b))]
    df = spark.createDataFrame(data, "ord long, qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string, tags map<string,string>")
    m = {x["statistic"]: x["value"] for x in Q.metrics(df, rows)[0].collect()}
    sizes = [700] * 5 + [100] * 2
    want = {
        "Duplicate Rate of Mapped, excluding Globins": 2 / 12, "End 1 Mismatch Rate": 2 / 800, "End 2 Mismatch Rate": 7 / 740, "Expression Profiling Efficiency": 14 / 18, "High Quality Exonic Rate": 14 / 16, "High Quality Intronic Rate": 1 / 16,
        "High Quality Intergenic Rate": 0, "High Quality Intragenic Rate": 15 / 16, "High Quality Ambiguous Alignment Rate": 1 / 16, "rRNA Rate": 2 / 18, "End 1 Sense Rate": 7 / 8, "End 2 Sense Rate": 1 / 8, "Avg. Splits per Read": 1 / 18,
        "Genes used in 3' bias": 1, "Mean 3' bias": 7 / 12, "Median 3' bias": 7 / 12, "3' bias Std": 0, "3' bias MAD": 0, "3' Bias, 25th Percentile": 7 / 12, "3' Bias, 75th Percentile": 7 / 12,
        "Average Fragment Length": 3700 / 7, "Fragment Length Median": 700, "Fragment Length Std": (sum((x - 3700 / 7) ** 2 for x in sizes) / 7) ** 0.5, "Fragment Length MAD": 0,
    }
    assert {n: m.get(n) for n in want} == pytest.approx(want)
    assert len(m) == 49 and m["Base Mismatch"] == pytest.approx(9 / 1540) and m["End 1 Mapping Rate"] == 1 and m["Read Length"] == 100
    assert m["Estimated Library Complexity"] == pytest.approx(Q.library_complexity(7, 2)) and m["Total Reads (Raw)"] == 18
    one = spark.createDataFrame([(0, "G", True, "-", 100, 300, 400, 310, 330), (1, "G", True, "+", 100, 300, 400, 310, 330), (2, "G", True, "+", 0, 0, 9, 0, 9)], "read long, gene_id string, full boolean, strand string, offset long, e_start long, e_end long, b_start long, b_end long")
    held = spark.createDataFrame([(0, "G"), (1, "G"), (2, "G")], "read long, gene_id string")
    got = Q.spliced_cover(one, held, held.select("read", (F.col("read") < 2).alias("hq")))
    assert sorted(map(tuple, got.collect())) == [("G", 110, 130), ("G", 170, 190)]


def frame(spark, data):
    return spark.createDataFrame([(i, *x) for i, x in enumerate(data)], "ord long, seqname string, feature string, start long, end long, strand string, gene_id string, transcript_id string, gene_name string, gene_biotype string, tag string")


def test_refine(spark):
    rows = [
        ("c", "exon", 1, 100, "+", "g", "t", "n", None, None), ("c", "exon", 101, 150, "+", "g", "t", "n", None, None), ("c", "exon", 201, 300, "+", "g", "t", None, None, None), ("c", "CDS", 50, 150, "+", "g", "t", None, None, None), ("c", "CDS", 201, 250, "+", "g", "t", None, None, None),
        ("c", "exon", 1, 9, "+", "two", "a", None, None, None), ("d", "exon", 1, 9, "+", "two", "a", None, None, None),
        ("c", "exon", 1, 9, "-", "bad", "b", None, None, None), ("c", "CDS", 5, 20, "-", "bad", "b", None, None, None),
        ("c", "exon", 9, 1, "+", "rev", "r", None, None, None), ("c", "exon", 1, 5, "+", "notx", None, None, None, None),
    ]
    final, lost = N.refine(frame(spark, rows))
    got = {(r["gene_id"], r["feature"], r["start"], r["end"], r["exon_number"]) for r in final.collect()}
    assert got == {("g", "gene", 1, 300, None), ("g", "transcript", 1, 300, None), ("g", "exon", 1, 150, 1), ("g", "exon", 201, 300, 2), ("g", "CDS", 50, 150, 1), ("g", "CDS", 201, 250, 2), ("g", "start_codon", 50, 52, None), ("g", "stop_codon", 251, 253, None)}
    r = final.where("feature = 'exon'").first()
    assert r["gene_biotype"] == "protein_coding" and r["gene_name"] == "n" and r["tag"] == "Ensembl_canonical"
    assert {r["gene_id"] for r in lost.collect()} == {"two", "bad"}


def test_prepare(spark):
    rows = [
        ("c", "exon", 11, 30, "+", "g1", "t1", None, None, "basic"), ("c", "exon", 51, 70, "+", "g1", "t1", None, None, "basic"), ("c", "start_codon", 20, 22, "+", "g1", "t1", None, None, "basic"), ("c", "stop_codon", 62, 64, "+", "g1", "t1", None, None, "basic"),
        ("c", "exon", 1, 999, "+", "g1", "t9", None, None, None), ("c", "exon", 121, 150, "-", "g2", "t2.2", None, None, None), ("c", "exon", 21, 50, "-", "g2", "t2.2", None, None, None), ("c", "exon", 1, 50, "-", "g2", "t2.3", None, None, None),
        ("c", "exon", 1, 5, "+", "g3", "x", None, None, None), ("d", "exon", 1, 5, "+", "g3", "x", None, None, None),
    ]
    got = {r["gene_id"]: r for r in N.prepare(frame(spark, rows)).collect()}
    assert set(got) == {"g1", "g2"} and got["g1"]["spans"] == "11-30,51-70" and (got["g1"]["start_codon"], got["g1"]["stop_codon"], got["g1"]["transcript_start"], got["g1"]["transcript_end"]) == (20, 62, 11, 70)
    assert got["g2"]["transcript_id"] == "t2.2" and got["g2"]["spans"] == "121-150,21-50"


def test_prepare_kinds_and_gff_names(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(N.gff_transcript(F.lit(x))) for x in ("NbL1.1.exon.1", "Csa3.1.exon1", "exon-XM_01.2-1", "a.exon.b.exon.2", "none")] == ["NbL1.1", "Csa3.1", "XM_01.2", "a.exon.b", None]
    data = [(0, "c", "gene", 1, 90, "+", "G", None, "n", "miRNA", None, None), (1, "c", "exon", 1, 9, "+", "G", "t1", "n", None, None, "primary_transcript"), (2, "c", "exon", 1, 5, "+", "H", "t2", "m", None, None, "tRNA"), (3, "c", "exon", 11, 15, "+", "H", "t2", "m", None, None, "rRNA"), (4, "c", "exon", 1, 5, "+", "K", "t3", "m", None, None, "tRNA")]
    rows = spark.createDataFrame(data, "ord long, seqname string, feature string, start long, end long, strand string, gene_id string, transcript_id string, gene_name string, gene_biotype string, tag string, transcript_biotype string")
    got = {r["gene_id"]: (r["transcript_id"], r["transcript_biotype"]) for r in N.prepare(rows).collect()}
    assert got == {"G": ("t1", "miRNA"), "K": ("t3", "tRNA")}  # the rows of t2 disagree
    assert [r["gene_id"] for r in N.prepare(rows, biotype="tRNA").collect()] == ["K"]
    bare = spark.createDataFrame([(None, None, "P", "P.exon.2"), ("g", "t", "P", "P.exon.2"), (None, None, "P", "x")], "gene_id string, transcript_id string, parent string, identifier string")
    assert sorted(map(tuple, N.with_identity(bare).collect()), key=str) == sorted([("P", "P"), ("g", "t"), (None, None)], key=str)


def test_refine_names_and_cds_numbers(spark):
    data = [(f, a, b, "+", g, f"t{g}", "same") for g, off in (("A", 0), ("B", 1000)) for f, a, b in (("exon", off + 1, off + 30), ("exon", off + 51, off + 90), ("CDS", off + 11, off + 30), ("CDS", off + 51, off + 60))]
    rows = spark.createDataFrame([(i, "c", f, a, b, s, g, t, n, "x", None) for i, (f, a, b, s, g, t, n) in enumerate(data)], "ord long, seqname string, feature string, start long, end long, strand string, gene_id string, transcript_id string, gene_name string, gene_biotype string, tag string")
    out = N.refine(rows)[0].collect()
    assert {(r["gene_id"], r["gene_name"]) for r in out} == {("A", "same"), ("B", "same_B")}
    assert sorted((r["gene_id"], r["start"], r["exon_number"]) for r in out if r["feature"] == "CDS") == [("A", 11, 1), ("A", 51, 2), ("B", 1011, 1), ("B", 1051, 2)]


def test_names(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    for a, b in {"RNU2-27P": "U2", "RNU5E-10P": "U5E", "RNU4ATAC7": "U4atac", "RNVU1-1": "U1V", "snRNA:U2:38ABb": "U2"}.items():
        assert one(G.snrna_name(F.lit(a))) == b
    for a, b in {"ACA64": "SNORA64", "U3": "SNORD3A", "U3b1": "SNORD3B", "U8": "SNORD118", "Z6": "Z6", "other": "other"}.items():
        assert one(G.snorna_name(F.lit(a))) == b
    assert one(G.misc_biotype(F.lit("misc_RNA"), F.lit("RNY4P28"))) == "Y_RNA_pseudogene" and one(G.family(F.lit("miRNA"), F.lit("MIR12-1"))) == "MIR12" and one(G.family(F.lit("tRNA"), F.lit("x_tRNA-Lys-CTT-1-7"))) == "tRNA-Lys-CTT"
    assert one(N.sanitized(F.lit("a b"))).startswith("a_b_") and one(N.sanitized(F.lit("ok-1"))) == "ok-1" and one(N.sanitized(F.lit(""))) == ""
    assert one(N.with_canonical_tag(F.lit("basic"))) == "basic; Ensembl_canonical" and one(N.with_canonical_tag(F.lit(None).cast("string"))) == "Ensembl_canonical"


def test_names_by_product(spark):
    data = [("snRNA", "X1", "U6 spliceosomal RNA", "U6"), ("snRNA", "X1", "U7 small nuclear RNA", "U7"), ("snRNA", "X1", "", "Ux"), ("snoRNA", "Gm5", "small nucleolar RNA SNORD51", "Snord51"), ("snoRNA", "Q", "small nucleolar SNORD12/SNORD106", "SNORD12/SNORD106"), ("snoRNA", "Q", "small nucleolar RNA U3", "SNORD3A"),
            ("snoRNA", "Q", "small nucleolar RNA Z6", "SNORx"), ("scaRNA", "Q", "small Cajal body-specific RNA 4", "SCARNA4"), ("scaRNA", "SCARNA9", "small Cajal body-specific RNA 4", "SCARNA9"), ("miRNA", "Mir3535", None, "SNORx"), ("miRNA", "Mir7-2", None, "Mir7")]
    df = spark.createDataFrame(data, "b string, n string, p string, want string")
    assert df.where(G.family(F.col("b"), F.col("n"), F.col("p")) != F.col("want")).collect() == []
    kinds = spark.createDataFrame([("miRNA", "Mir3535", "snoRNA"), ("miRNA", "Mir3", "miRNA"), ("misc_RNA", "RNY4", "Y_RNA")], "b string, n string, want string")
    assert kinds.where(G.settled_biotype(F.col("b"), F.col("n")) != F.col("want")).count() == 0


def test_large_families():
    """A family of 1,500 sequences is aligned and clustered in seconds; a small one as by the plain rules on whole numbers."""
    from fractions import Fraction

    dice = random.Random(3)
    word = lambda n: "".join(dice.choice("ACGT") for _ in range(n))
    big = sorted({"ACGT" + word(17) for _ in range(1500)})
    began = time.process_time()
    rows_ = G.align(big)
    ids = G.cluster(rows_, 0.3)
    assert time.process_time() - began < 60 and [r.replace("-", "") for r in rows_] == big and len({len(r) for r in rows_}) == 1 and len(ids) == len(big)

    def plain(rows, threshold):
        def far(a, b):
            both = [(x, y) for x, y in zip(a, b, strict=True) if not x == y == "-"]
            return Fraction(sum(x != y for x, y in both), len(both)) if both else Fraction(0)

        groups = [[i] for i in range(len(rows))]
        while len(groups) > 1:
            d, i, j = min((sum(far(rows[x], rows[y]) for x in groups[i] for y in groups[j]) / (len(groups[i]) * len(groups[j])), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
            if d > Fraction(str(threshold)):
                break
            groups[i] += groups.pop(j)
        return {i: n for n, g in enumerate(sorted(groups, key=lambda g: (-len(g), min(g))), 1) for i in g}

    for threshold in (0.1, 0.3, 0.5):
        base = [word(20), word(22)]
        small = sorted({"".join(dice.choice("ACGT") if dice.random() < 0.2 else ch for ch in dice.choice(base)) for _ in range(14)})
        got = G.align(small)
        assert G.cluster(got, threshold) == list(map(plain(got, threshold).get, range(len(got))))
    # of equal scores a pair goes before a gap, whatever the number of rows: rounding has no say
    assert G.align(["ACGT", "ACGA", "ACGC", "TTT"])[3].replace("-", "") == "TTT" and G.cluster(["AC-", "AC-", "GG-"], 0.0) == [1, 1, 2]


def test_groups(spark):
    assert G.align(["ACGTACGT", "ACGACGT", "ACGTACGT"]) == ["ACGTACGT", "ACG-ACGT", "ACGTACGT"] and G.align([]) == []
    assert G.cluster(["ACGTACGT", "ACG-ACGT", "TTTTTTTT"], 0.2) == [1, 1, 2] and G.consensus(["AC", "A-", "-C"]) == "AC" and G.gapless_positions("-AC--G") == [(1, 2, 0), (5, 5, 2)]
    genes = spark.createDataFrame([("f", "a", "ACGTACGTAC"), ("f", "b", "ACGTACGTAC"), ("f", "c", "GGGGGGGGGG"), ("h", "d", "")], "family string, gene_id string, seq string")
    got = {r["gene_id"]: (r["cluster_id"], r["consensus"]) for r in G.cluster_families(genes).collect()}
    assert got["a"] == got["b"] == (1, "ACGTACGTAC") or got["a"] == got["b"]
    items = spark.createDataFrame([(1, "Ux", 0, "ACGTACGTACGTACGTAA", True, "sn"), (2, "U1", 1, "TTACGTACGTACGTACGTAATT", False, "sn"), (3, "U2", 2, "GG", False, "sn"), (4, "Ux", 3, "", True, "sn")], "id long, name string, ord long, seq string, placeholder boolean, kind string")
    assert [tuple(r) for r in G.contained_in(items, "kind").collect()] == [(1, 2)]


def test_sources(spark, rows, tmp_path):
    assert gtf.is_gff("a.gff3.gz") and not gtf.is_gff("a.gtf")
    m = spark.createDataFrame([('gene_id "a;b"; tag "x"; tag "y"',)], "a string").select(gtf.attribute_map(F.col("a"))).first()[0]
    assert m == {"gene_id": "a;b", "tag": "x; y"}
    p = tmp_path / "x.gtf"
    p.write_text("\n".join([*GTF, "##FASTA", line("exon", 1, 2, "+", "late", "late")]) + "\n")
    df = gtf.read_gtf(spark, str(p), names=spark.createDataFrame([("chr1", "1")], "old string, new string"), search="^1$")
    assert df.count() == 8 and {r["seqname"] for r in df.collect()} == {"1"}
    gtf.write_gtf(df, str(tmp_path / "out"), "_ord", ["made here"])
    text = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(text) == 9 and any(x == "#made here" for x in text)
    f = tmp_path / "x.fa"
    f.write_text(">chr1 desc\n" + "\n".join(GENOME[i : i + 60] for i in range(0, 330, 60)) + "\n>chr2\nACGT\n")
    chunks = tables.read_fasta(spark, str(f), 100)
    assert "".join(r["seq"] for r in chunks.where("chrom = 'chr1'").orderBy("chunk").collect()) == GENOME
    assert rows(chunks.where("chrom = 'chr2'"), "seq") == [("ACGT",)]
    f.write_text("\n".join(f">c{i}\n" + "\n".join("ACGTACGTAC"[: 1 + (i + k) % 10] for k in range(i % 7)) for i in range(300)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    many = {r["chrom"]: r["seq"] for r in tables.read_fasta(spark, str(f), 1000).collect()}
    assert many == {f"c{i}": "".join("ACGTACGTAC"[: 1 + (i + k) % 10] for k in range(i % 7)) for i in range(300) if i % 7}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    lines = spark.createDataFrame([(0, ">a x"), (1, "AC"), (2, "GT"), (3, ">b"), (4, "TT")], "no long, value string").repartition(3)
    renamed = tables.rename_fasta(lines, spark.createDataFrame([("a", "chrA")], "old string, new string"), "^chr")
    assert rows(renamed, "no", "value") == [(0, ">chrA"), (1, "AC"), (2, "GT")]
    mo = tmp_path / "m.txt"
    mo.write_text("# c\nACG\t2\nACT\nAAA\tx\n")
    assert rows(tables.read_motifs(spark, str(mo)), "motif", "weight") == [("AAA", 1.0), ("ACG", 2.0), ("ACT", 1.0)]
    with pytest.raises(ValueError):
        tables.sites(spark.createDataFrame([("a",)], "x string"), (0, 1, 2))
    s = tables.sites(spark.createDataFrame([("c", "5", "9", "+", "k")], "chrom string, b string, c string, d string, start string"), (0, 1, 2, 3)).first()
    assert (s["start"], s["end"], s["_original_start"]) == (5, 9, "k")
    assert [r[0] for r in spark.createDataFrame([(1e6,), (0.1234567,), (None,)], "x double").select(tables.six_digits("x")).collect()] == ["1e+06", "0.123457", "nan"]


def test_folders_keep_the_order_of_files(spark, tmp_path):
    """Files of unequal size, split into many parts: rows stay in their file's order and contig."""
    r = random.Random(31)
    folder = tmp_path / "fa"
    folder.mkdir()
    want = {}
    for name, n in (("A", 7200), ("B", 4800), ("C", 300)):
        want[name] = "".join(r.choices("ACGT", k=n))
        (folder / f"{name}.fa").write_text(f">{name} x\n" + "\n".join(want[name][i : i + 60] for i in range(0, n, 60)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        chunks = tables.read_fasta(spark, str(folder), 1000).orderBy("chrom", "chunk").collect()
        assert {k: "".join(c["seq"] for c in chunks if c["chrom"] == k) for k in want} == want
        gff = tmp_path / "gff"
        gff.mkdir()
        for name, n in (("a", 150), ("b", 90)):
            rows = [f"{name}\ts\tgene\t{i + 1}\t{i + 9}\t.\t+\t.\tID={name}{i}" for i in range(n)]
            (gff / f"{name}.gff3").write_text("\n".join(["##gff-version 3", *rows, *(["##FASTA", ">x", "ACGT"] if name == "a" else [])]) + "\n")
        got = gtf.read_gtf(spark, str(gff), gff=True).orderBy("_ord").select("seqname", "start").collect()
        assert [tuple(x) for x in got] == [("a", i + 1) for i in range(150)] + [("b", i + 1) for i in range(90)]
        ids = tables.with_record_id(spark.read.text(str(gff / "b.gff3")), "no").orderBy("no").collect()
        assert [x["no"] for x in ids] == list(range(91)) and ids[1]["value"].startswith("b\ts\tgene\t1\t")
        assert gtf.read_comments(spark, str(gff / "a.gff3")) == ["##gff-version 3"]
        (gff / "c.gff3").write_text("x\ty\n")
        with pytest.raises(ValueError):
            gtf.read_gtf(spark, str(gff / "c.gff3"), strict=True)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    many = spark.createDataFrame([(0, "q\t0\tc\t1\t60\t1M\t*\t0\t0\tA\tI" + "".join(f"\t{a}{b}:i:{i}" for i, (a, b) in enumerate((a, b) for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for b in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")))], "ord long, value string")
    assert len(reads.parse_sam(many).first()["tags"]) == 1352


def test_reference_io(spark, exons, tmp_path):
    E.write_reference(exons.withColumnsRenamed({"chrom": "chromosome", "e_start": "start", "e_end": "end", "start_offset": "start_exon", "end_offset": "end_exon"}).withColumn("start_offset", F.col("start_exon")).withColumn("end_offset", F.col("end_exon")), str(tmp_path / "mini.parquet"))
    refs = tables.References(str(tmp_path))
    assert refs.names() == ["mini"] and refs.load(spark, "mini").count() == 4
    with pytest.raises(ValueError):
        refs.resolve("other")
    table = {r["transcript_id"]: r for r in E.export_table(exons).collect()}
    assert table["t1"]["spans"] == "11-30,51-70" and (table["t1"]["start_codon"], table["t1"]["stop_codon"]) == (20, 62) and (table["t2"]["start_codon"], table["t2"]["stop_codon"]) == (139, 130)
    again = E.exon_reference(E.export_gtf(exons))
    cols = ["transcript_id", "e_start", "e_end", "start_offset", "transcript_length", "transcript_level", "start_codon_pos", "stop_codon_pos"]
    assert sorted(map(str, again.where("gene_id <> 'x'").select(*cols).collect())) == sorted(map(str, exons.withColumn("transcript_level", F.when(F.col("transcript_level") == 6, 10).otherwise(F.col("transcript_level"))).select(*cols).collect()))


def test_streaming(spark, exons, tmp_path):
    from strandloom.streaming import sites as ST

    src = tmp_path / "in"
    spark.createDataFrame([("chr1", 26, "+", "2024-01-01 00:00:00"), ("chr1", 141, "-", "2024-01-01 05:00:00"), ("chr1", 5, "+", "2024-01-02 00:00:00")], "chrom string, pos long, strand string, t string").withColumn("t", F.col("t").cast("timestamp")).write.parquet(str(src))
    stream = spark.readStream.schema("chrom string, pos long, strand string, t timestamp").parquet(str(src))
    q = ST.region_windows(ST.locate(stream, ST.exon_cells(exons)), "t").writeStream.outputMode("complete").format("memory").queryName("regions").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["region"], r["sites"]) for r in spark.table("regions").collect()) == [("CDS", 1), ("FivePrimeUTR", 1)]
