"""Sites and variants on transcripts: region, codon, effect and distance to the splice site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.seq import padded_motif, protein_text, reverse_base, to_rna, translate_codon
from strandloom.operators.intervals import overlap_join, overlap_pairs
from strandloom.operators.skew import keyed_left_join
from strandloom.runtime import cut

# Two orders of severity, least severe first, and the coarse kinds of effects.
REGION_RANK = ("Intergenic", "Intronic", "NoncodingTranscript", "IncompleteTranscript", "FivePrimeUTR", "ThreePrimeUTR", "IntronicSpliceSite", "Silent", "CDS", "Substitution", "ComplexSubstitution", "InFrameIndel", "FrameShift", "PrematureStop", "SpliceSite")
EFFECT_RANK = (
    "Intergenic", "Intragenic", "NoncodingTranscript", "IncompleteTranscript", "Intronic", "IntronicSpliceSite", "FivePrimeUTR", "ThreePrimeUTR", "Silent", "CDS", "Substitution", "SpliceAcceptor", "SpliceDonor",
    "ExonicSpliceSite", "AlternateStartCodon", "ExonLoss", "InFrameIndel", "FrameShift", "FrameShiftTruncation", "Deletion", "Insertion", "ComplexSubstitution", "PrematureStop", "StartLoss", "StopLoss",
)
COARSE = {
    **dict.fromkeys(("AlternateStartCodon", "StartLoss"), "StartCodon"), "StopLoss": "StopCodon",
    **dict.fromkeys(("ComplexSubstitution", "Deletion", "ExonLoss", "FrameShiftTruncation", "FrameShift", "Insertion", "PrematureStop", "Substitution", "Silent"), "CDS"),
    **dict.fromkeys(("ExonicSpliceSite", "IntronicSpliceSite", "SpliceAcceptor", "SpliceDonor"), "SpliceSite"),
}
COLUMNS = ("gene_id", "transcript_id", "transcript_pos", "region", "gene_pos", "transcript_strand", "mut_type", "transcript_motif", "coding_pos", "codon_ref", "aa_pos", "aa_ref", "distance2splice")
EFFECT_COLUMNS = ("mut_type", "gene_type", "gene_name", "gene_pos", "transcript_name", "transcript_pos", "transcript_motif", "transcript_strand", "coding_pos", "codon_ref", "aa_pos", "aa_ref", "distance2splice")


def transcripts(exons: DataFrame) -> DataFrame:
    """One row per transcript: exons from 5' to 3' as array<struct<t_start, t_end, g_start, g_end>>, the body's span, the codons.

    An array holds one transcript's exons.
    """
    e = F.struct(F.col("start_offset").alias("t_start"), F.col("end_offset").alias("t_end"), F.col("e_start").alias("g_start"), F.col("e_end").alias("g_end"))
    return exons.groupBy("gene_id", "transcript_id", "chrom", "strand").agg(F.array_sort(F.collect_list(e)).alias("exons"), F.min("e_start").alias("lo"), F.max("e_end").alias("hi"), F.min("start_codon_pos").cast("long").alias("start_codon_pos"), F.min("stop_codon_pos").cast("long").alias("stop_codon_pos"), F.max("transcript_length").alias("transcript_length"))


def exonic(exons: Column, pos: Column) -> Column:
    return F.exists(exons, lambda e: (e["g_start"] <= pos) & (pos < e["g_end"]))


def transcript_pos(exons: Column, strand: Column, pos: Column) -> Column:
    """The 0-based transcript position of a genome position, null between exons."""
    e = F.get(F.filter(exons, lambda x: (x["g_start"] <= pos) & (pos < x["g_end"])), F.lit(0))
    return F.when(strand == "-", e["g_end"] - 1 - pos + e["t_start"]).otherwise(pos - e["g_start"] + e["t_start"])


def genome_pos(exons: Column, strand: Column, tpos: Column) -> Column:
    """The 0-based genome position of a transcript position, null beyond the transcript."""
    e = F.get(F.filter(exons, lambda x: (x["t_start"] <= tpos) & (tpos < x["t_end"])), F.lit(0))
    return F.when(strand == "-", e["g_end"] - 1 - (tpos - e["t_start"])).otherwise(e["g_start"] + tpos - e["t_start"])


def region(tpos: Column, start_codon: Column, stop_codon: Column) -> Column:
    """Noncoding without a start codon; the stop codon is part of the CDS; a start without stop has no 3'UTR."""
    return F.when(start_codon.isNull(), "NoncodingTranscript").when(tpos < start_codon, "FivePrimeUTR").when(tpos >= stop_codon + 3, "ThreePrimeUTR").otherwise("CDS")


def splice_distance(exons: Column, strand: Column, pos: Column) -> Column:
    """The signed distance to the nearest inner exon border: of the first exon only its 3' border counts, of the
    last its 5' border, of the others both. Of two as near the first from 5' counts; null for one exon.
    """
    n = F.size(exons)
    minus = strand == "-"
    five = lambda e: F.when(minus, e["g_end"] - pos).otherwise(pos - e["g_start"])
    three = lambda e: F.when(minus, e["g_start"] - pos).otherwise(pos - e["g_end"])
    each = F.transform(exons, lambda e, i: F.filter(F.array(F.when(i > 0, five(e)), F.when(i < n - 1, three(e))), lambda x: x.isNotNull()))
    ranked = F.transform(F.flatten(each), lambda x, i: F.struct(F.abs(x).alias("a"), i.alias("i"), x.alias("x")))
    return F.when(n > 1, F.array_min(ranked)["x"])


def alleles(df: DataFrame, flip: bool) -> DataFrame:
    """ref and alt in upper case; on the minus strand their reverse complements when `flip`."""
    for c in ("ref", "alt"):
        up = F.upper(F.col(c))
        df = df.withColumn(c, F.when(up.isin("-", "N", "", "."), up).when(F.lit(flip) & (F.col("strand") == "-"), reverse_base(up)).otherwise(up))
    return df


def real_base(c: Column) -> Column:
    return c.isNotNull() & ~c.isin("", "-", ".", "N")


def effect(codon: Column, ref: Column, alt: Column, offset: Column) -> Column:
    """What a change within the CDS does. offset: the base's place in its codon, 0 to 2."""
    changed = F.concat(codon.substr(F.lit(1), offset), alt, codon.substr(offset + 2, F.lit(3)))
    a, b = translate_codon(codon), translate_codon(changed)
    single = (F.length(ref) == 1) & (F.length(alt) == 1)
    snv = F.when((F.length(codon) < 3) | a.isNull() | b.isNull(), "CDS").when(a == b, "Silent").when(b == "STOP", "PrematureStop").otherwise("Substitution")
    return F.when(single, snv).when(F.length(ref) == F.length(alt), "ComplexSubstitution").when((F.length(ref) - F.length(alt)) % 3 == 0, "InFrameIndel").otherwise("FrameShift")


def spliced(exons: DataFrame, bases: DataFrame) -> DataFrame:
    """(gene_id, transcript_id, seq): spliced sequences from exons with `seq` of the plus strand, minus ones reversed."""
    from strandloom.functions.seq import reverse_complement

    s = F.when(F.col("strand") == "-", reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    return bases.groupBy("gene_id", "transcript_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_offset", s.alias("s")))), lambda x: x["s"]), "").alias("spliced"))


def annotate(sites: DataFrame, exons: DataFrame, sequences: DataFrame | None = None, pad: int = 10, flip: bool = False, every: bool = False, exon_only: bool = False) -> DataFrame:
    """sites (site_id, chrom, pos 1-based, strand, ref, alt) with the 13 annotation columns and `hit_no`.

    Transcripts whose body holds the site count, whatever the strand, in the order of (lo, hi, ids); a site in
    none is Intergenic. Without `every` only the most severe is kept, the first of equal ones. sequences:
    (gene_id, transcript_id, spliced). exon_only drops hits between exons.
    """
    tx = transcripts(exons).withColumnRenamed("strand", "transcript_strand")
    left = alleles(sites, flip).withColumn("_p", F.col("pos").try_cast("bigint") - 1).where("_p is not null")
    # exons and texts are wide: a hit takes from them what it needs where it meets them, and goes on narrow
    hit = overlap_pairs(left.select("site_id", "chrom", "_p", "ref", "alt"), tx, ["chrom"], ("_p", None), ("lo", "hi"), ["site_id"])
    p, strand = F.col("_p"), F.col("transcript_strand")
    if exon_only:
        hit = hit.where(exonic(F.col("exons"), p))
    hit = hit.withColumn("transcript_pos", transcript_pos(F.col("exons"), strand, p)).withColumn("distance2splice", F.when(F.col("transcript_id").isNotNull(), splice_distance(F.col("exons"), strand, p))).drop("exons", "_p")
    t, start, stop = F.col("transcript_pos"), F.col("start_codon_pos"), F.col("stop_codon_pos")
    found = F.col("transcript_id").isNotNull()
    within = found & t.isNotNull()
    hit = hit.withColumn("region", F.when(~found, "Intergenic").when(~within, "Intronic").otherwise(region(t, start, stop))).withColumn("gene_pos", F.when(within, t + F.coalesce(start, F.lit(0))))
    in_cds = within & (F.col("region") == "CDS")
    if sequences is not None:
        # only hits on exons look into the texts; the translation is made once for each transcript
        hit = cut(hit)
        key = F.concat_ws("\x1f", "gene_id", "transcript_id", "chrom", "transcript_strand")
        coding = F.when(start.isNotNull(), F.col("spliced").substr((start + 1).cast("int"), F.coalesce(stop + 3 - start, F.length("spliced") - start).cast("int")))
        of = sequences.select(F.col("gene_id").alias("_g"), F.col("transcript_id").alias("_t"), "spliced")
        texts = tx.select("gene_id", "transcript_id", key.alias("_tx"), "start_codon_pos", "stop_codon_pos").join(of, F.col("gene_id").eqNullSafe(F.col("_g")) & (F.col("transcript_id") == F.col("_t")))
        texts = texts.select("_tx", "spliced", protein_text(coding).alias("_protein"))
        exonic_hits = keyed_left_join(hit.where(within).withColumn("_tx", key), texts, "_tx", ["site_id"]).drop("_tx")
        hit = exonic_hits.unionByName(hit.where(~within), allowMissingColumns=True)
    else:
        hit = hit.withColumn("spliced", F.lit(None).cast("string")).withColumn("_protein", F.lit(None).cast("string"))
    seq = F.col("spliced")
    hit = hit.withColumn("transcript_motif", F.when(within & seq.isNotNull(), padded_motif(seq, t, pad)))
    readable = in_cds & start.isNotNull() & seq.isNotNull()
    length = F.coalesce(stop + 3 - start, F.length(seq) - start).cast("int")
    hit = hit.withColumn("coding_pos", F.when(readable, t - start))
    c = F.col("coding_pos")
    first = (F.floor(c / 3) * 3).cast("int")
    # the codon within the CDS, which may end before it does
    codon = seq.substr((start + 1).cast("int") + first, F.greatest(F.least(F.lit(3), length - first), F.lit(0)))
    hit = hit.withColumn("codon_ref", F.when(readable, codon)).withColumn("aa_pos", F.when(readable, F.floor(c / 3) + 1))
    # the amino acid is looked up in the joined translation, in which a stop takes four letters
    hit = hit.withColumn("aa_ref", F.when(readable, F.col("_protein").substr(F.col("aa_pos").cast("int"), F.lit(1))))
    change = readable & real_base(F.col("ref")) & real_base(F.col("alt")) & (F.col("codon_ref") != "")
    no_seq = "IncompleteTranscript" if exon_only or sequences is not None else "CDS"
    kind = F.when(change, effect(F.col("codon_ref"), F.col("ref"), F.col("alt"), (c % 3).cast("int"))).when(in_cds & seq.isNull(), no_seq).otherwise(F.col("region"))
    hit = hit.withColumn("mut_type", F.when(found, kind))
    keep = [c for c in sites.columns if c not in COLUMNS]
    own = left.select(*keep)
    if every:
        rows = hit.select("site_id", *COLUMNS)
        return own.join(rows, "site_id", "inner" if exon_only else "left").select(*keep, *[F.coalesce(c, F.lit("Intergenic")).alias(c) if c == "region" else c for c in COLUMNS])
    # what a hit is worth, and its place among the site's hits
    names = EFFECT_RANK if exon_only else REGION_RANK
    rank = F.coalesce(F.try_element_at(F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))]), F.coalesce("mut_type", "region")), F.lit(-1))
    rows = hit.select("site_id", F.struct(-rank, F.struct("lo", "hi", "gene_id", "transcript_id")).alias("_order"), F.struct(*COLUMNS).alias("_hit"))
    # a site's own row has its columns and no hit
    rest = [c for c in keep if c != "site_id"]
    both = rows.unionByName(own.select("site_id", F.struct(*rest).alias("_own")), allowMissingColumns=True)
    best = both.groupBy("site_id").agg(F.min_by("_hit", "_order").alias("b"), F.first("_own", True).alias("o"))
    if exon_only:
        best = best.where("b is not null")
    return best.select("site_id", "o.*", *[F.coalesce(x, F.lit("Intergenic")).alias(c) if c == "region" else x.alias(c) for c in COLUMNS for x in (F.col("b")[c],)])


def as_effects(annotated: DataFrame, names: DataFrame | None = None, rename: bool = False) -> DataFrame:
    """The older schema of 13 columns; rename gives the coarse kinds. names: (gene_id, gene_name)."""
    kind = F.coalesce("mut_type", "region")
    if rename:
        kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in COARSE.items() for x in kv]), kind), kind)
    df = annotated.join(names, "gene_id", "left") if names is not None else annotated.withColumn("gene_name", F.col("gene_id"))
    keep = [c for c in annotated.columns if c not in COLUMNS]
    out = {"mut_type": kind, "gene_type": F.lit(None).cast("string"), "transcript_name": F.col("transcript_id")}
    return df.select(*keep, *[out.get(c, F.col(c)).alias(c) if c in out else F.col(c) for c in EFFECT_COLUMNS])


def for_text(df: DataFrame, null: str = "") -> DataFrame:
    """All columns as text, a null as the given word (empty, or None for effects)."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(null)).alias(c) for c in df.columns])


def annotate_table(sites: DataFrame, exons: DataFrame, keep_na: bool = True) -> DataFrame:
    """Sites on an annotation table's exons by chromosome and strand, one row per hit; misses have `.` when kept."""
    right = exons.select("chrom", "strand", "e_start", "e_end", "offset", "gene_id", "transcript_id", "exon_no")
    left = sites.withColumn("_p", F.col("pos").try_cast("bigint") - 1).where("_p is not null")
    hit = overlap_join(left, right, ["chrom", "strand"], ("_p", None), ("e_start", "e_end"), "site_id", "left" if keep_na else "inner")
    t = F.when(F.col("strand") == "-", F.col("e_end") - 1 - F.col("_p")).otherwise(F.col("_p") - F.col("e_start")) + F.col("offset")
    return hit.select(*sites.columns, F.coalesce("gene_id", F.lit(".")).alias("gene_id"), F.coalesce("transcript_id", F.lit(".")).alias("transcript_id"), F.coalesce(t.cast("string"), F.lit(".")).alias("transcript_pos"))


def unified(hits: DataFrame) -> DataFrame:
    """Hits on an annotation table in the columns of annotate(): what a table can't tell is empty."""
    return hits.select(*[c for c in hits.columns if c not in COLUMNS], *[F.col(c) if c in hits.columns else F.lit("").alias(c) for c in COLUMNS])


def collapse(hits: DataFrame, add_count: bool = False) -> DataFrame:
    """One row per site: its hits joined by commas, ordered by gene, transcript and position, perhaps with their number (0 for a miss)."""
    item = F.array_sort(F.collect_list(F.struct("gene_id", "transcript_id", "transcript_pos")))
    got = hits.groupBy("site_id").agg(item.alias("_h"))
    out = got.select("site_id", *[F.array_join(F.col("_h")[c], ",").alias(c) for c in ("gene_id", "transcript_id", "transcript_pos")], F.size(F.filter("_h", lambda x: x["gene_id"] != ".")).alias("hits"))
    return out if add_count else out.drop("hits")


def rna_codons(df: DataFrame) -> DataFrame:
    return df.withColumn("codon_ref", to_rna(F.col("codon_ref")))
