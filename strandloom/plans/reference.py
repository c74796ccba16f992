"""The exon reference: building it from GTF rows, choosing transcripts, exporting it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.sources.gtf import format_attributes, with_values

ATTRIBUTES = ("gene_id", "transcript_id", "gene_name", "gene_biotype", "exon_number", "tag", "transcript_support_level")


def transcript_level(tag: Column, support: Column) -> Column:
    """0 for a canonical transcript, else the support level's first word; NA gives 6, none or anything else 10."""
    word = F.get(F.split(support, " "), F.lit(0))
    return F.when(tag == "Ensembl_canonical", 0).when(F.upper(word).isin("NA", "NAN"), 6).otherwise(F.coalesce(word.try_cast("bigint"), F.lit(10)))


def five_prime(strand: Column, start: Column) -> Column:
    """Sorts exons from 5' to 3'."""
    return F.when(strand == "-", -start).otherwise(start)


def with_offsets(exons: DataFrame, by: tuple[str, ...] = ("gene_id", "transcript_id")) -> DataFrame:
    """Adds start_offset, end_offset (positions in the transcript) and transcript_length to exons with e_start, e_end, strand."""
    w = Window.partitionBy(*by).orderBy(five_prime(F.col("strand"), F.col("e_start")), "e_end", "chrom", "strand")
    size = F.col("e_end") - F.col("e_start")
    ends = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return exons.withColumn("end_offset", ends).withColumn("start_offset", F.col("end_offset") - size).withColumn("transcript_length", F.sum(size).over(Window.partitionBy(*by)))


def split_codons(rows: DataFrame) -> DataFrame:
    """One base per codon: of a split start codon the 5'-most piece's, of a stop codon the 3'-most piece's."""
    base = F.when(F.col("strand") == "-", F.col("end") - 1).otherwise(F.col("start"))
    low = (F.col("feature") == "start_codon") == (F.col("strand") != "-")
    return rows.where(F.col("feature").isin("start_codon", "stop_codon")).groupBy("chrom", "gene_id", "transcript_id", "feature", "strand").agg(F.min(base).alias("_lo"), F.max(base).alias("_hi")).withColumn("base", F.when(low, F.col("_lo")).otherwise(F.col("_hi"))).drop("_lo", "_hi")


def exon_reference(rows: DataFrame) -> DataFrame:
    """One row per exon from GTF rows (seqname, feature, start, end, strand, attributes): offsets from 5' to 3',
    the transcript's length and level, and the codons' positions in it.

    The first value of an attribute counts. A codon outside its transcript's exons gives null.
    """
    picked = with_values(rows.where(F.col("feature").isin("exon", "start_codon", "stop_codon")).select(F.col("seqname").alias("chrom"), "feature", (F.col("start") - 1).alias("start"), "end", "strand", "attributes"), "attributes", ATTRIBUTES).drop("attributes")
    exons = picked.where("feature = 'exon'").withColumnRenamed("start", "e_start").withColumnRenamed("end", "e_end").withColumn("transcript_level", transcript_level(F.col("tag"), F.col("transcript_support_level"))).drop("feature", "tag", "transcript_support_level")
    exons = with_offsets(exons)
    codons = split_codons(picked)
    e = exons.select("chrom", "transcript_id", "e_start", "e_end", "start_offset", F.col("strand").alias("_es"))
    at = codons.join(e, ["chrom", "transcript_id"]).where((F.col("e_start") <= F.col("base")) & (F.col("base") < F.col("e_end")))
    pos = F.when(F.col("_es") == "-", F.col("e_end") - F.col("base") - 1).otherwise(F.col("base") - F.col("e_start")) + F.col("start_offset")
    wide = at.withColumn("_pos", pos).groupBy("transcript_id").agg(*[F.min(F.when(F.col("feature") == f, F.col("_pos"))).alias(f"{f}_pos") for f in ("start_codon", "stop_codon")])
    return exons.join(wide, "transcript_id", "left")


def best_transcripts(exons: DataFrame) -> DataFrame:
    """(gene_id, transcript_id): of each gene the transcript of lowest level, then greatest length, then smallest id."""
    return exons.groupBy("gene_id").agg(F.min_by("transcript_id", F.struct(F.coalesce("transcript_level", F.lit(1 << 40)), -F.col("transcript_length"), F.col("transcript_id"))).alias("transcript_id"))


def codon_coordinate(pos: Column, strand: Column, e_start: Column, e_end: Column, start_offset: Column, end_offset: Column) -> Column:
    """The 1-based genome coordinate of the transcript position, on the exon that holds it; null on others."""
    inside = (pos >= start_offset) & (pos < end_offset)
    return F.when(inside, F.when(strand == "-", e_end - (pos - start_offset)).otherwise(e_start + (pos - start_offset) + 1))


def export_table(exons: DataFrame) -> DataFrame:
    """One row per transcript: spans from 5' to 3' (1-based closed), and the codons' 1-based coordinates."""
    c = {n: codon_coordinate(F.col(f"{n}_pos"), F.col("strand"), F.col("e_start"), F.col("e_end"), F.col("start_offset"), F.col("end_offset")) for n in ("start_codon", "stop_codon")}
    span = F.struct("start_offset", F.concat((F.col("e_start") + 1).cast("string"), F.lit("-"), F.col("e_end").cast("string")).alias("s"))
    return exons.groupBy("gene_id", "transcript_id").agg(F.min("chrom").alias("chrom"), F.min("strand").alias("strand"), F.array_join(F.transform(F.array_sort(F.collect_list(span)), lambda x: x["s"]), ",").alias("spans"), F.max(c["start_codon"]).alias("start_codon"), F.max(c["stop_codon"]).alias("stop_codon"), (F.min("e_start") + 1).alias("transcript_start"), F.max("e_end").alias("transcript_end"))


def spliced_spans(exons: DataFrame) -> DataFrame:
    """(gene_id, transcript_id, spans): the exons' places in the spliced transcript, 1-based closed, from 5' to 3'."""
    span = F.struct("start_offset", F.concat((F.col("start_offset") + 1).cast("string"), F.lit("-"), F.col("end_offset").cast("string")).alias("s"))
    return exons.groupBy("gene_id", "transcript_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(span)), lambda x: x["s"]), ",").alias("spans"))


def export_gtf(exons: DataFrame) -> DataFrame:
    """GTF rows of genes, transcripts, exons and codons; level 0 becomes a tag, 6 and 10 are left out, others are a support level."""
    ident = [("gene_id", F.col("gene_id")), ("transcript_id", F.col("transcript_id")), ("gene_name", F.col("gene_name")), ("gene_biotype", F.col("gene_biotype"))]
    level = [("tag", F.when(F.col("transcript_level") == 0, "Ensembl_canonical")), ("transcript_support_level", F.when(~F.col("transcript_level").isin(0, 6, 10), F.col("transcript_level")))]
    number = Window.partitionBy("gene_id", "transcript_id").orderBy("start_offset")
    given = F.col("exon_number").cast("string") if "exon_number" in exons.columns else F.lit(None).cast("string")
    e = exons.withColumn("exon_number", F.coalesce(given, F.row_number().over(number).cast("string")))

    def rows(df: DataFrame, feature: str, start: Column, end: Column, attrs: list) -> DataFrame:
        return df.select(F.col("chrom").alias("seqname"), F.lit("reference").alias("source"), F.lit(feature).alias("feature"), start.alias("start"), end.alias("end"), F.lit(".").alias("score"), "strand", F.lit(".").alias("frame"), format_attributes(attrs).alias("attributes"))

    genes = e.groupBy("gene_id").agg(*[F.min(c).alias(c) for c in ("chrom", "strand", "gene_name", "gene_biotype", "e_start")], F.max("e_end").alias("e_end"))
    txs = e.groupBy("gene_id", "transcript_id").agg(*[F.min(c).alias(c) for c in ("chrom", "strand", "gene_name", "gene_biotype", "transcript_level", "e_start")], F.max("e_end").alias("e_end"))
    out = rows(genes, "gene", F.col("e_start") + 1, F.col("e_end"), [ident[0], *ident[2:]])
    out = out.unionByName(rows(txs, "transcript", F.col("e_start") + 1, F.col("e_end"), ident + level))
    out = out.unionByName(rows(e, "exon", F.col("e_start") + 1, F.col("e_end"), [*ident, ("exon_number", F.col("exon_number")), *level]))
    for n in ("start_codon", "stop_codon"):
        at = e.withColumn("_c", codon_coordinate(F.col(f"{n}_pos"), F.col("strand"), F.col("e_start"), F.col("e_end"), F.col("start_offset"), F.col("end_offset"))).where("_c is not null")
        minus = F.col("strand") == "-"
        out = out.unionByName(rows(at, n, F.when(minus, F.col("_c") - 2).otherwise(F.col("_c")), F.when(minus, F.col("_c")).otherwise(F.col("_c") + 2), [*ident, ("exon_number", F.col("exon_number"))]))
    return out


def broken(exons: DataFrame) -> DataFrame:
    """The transcripts of a reference whose offsets leave the transcript or don't end at its length; none in a sound one."""
    return exons.groupBy("gene_id", "transcript_id").agg(F.min("start_offset").alias("low"), F.max("end_offset").alias("high"), F.max("transcript_length").alias("length")).where("low <> 0 or high <> length")


def write_reference(exons: DataFrame, path: str) -> None:
    if broken(exons).limit(1).count():
        raise ValueError("exon offsets and transcript lengths disagree")
    exons.write.mode("overwrite").option("compression", "zstd").parquet(path)


def reference_points(exons: DataFrame, point: str) -> DataFrame:
    """(transcript_id, ref_pos) of tss, tes, start_codon, stop_codon or last_junction; for `junction` ref_pos is an array of all inner junctions."""
    by = exons.groupBy("transcript_id")
    if point == "tss":
        return by.agg(F.lit(0).cast("long").alias("ref_pos"))
    if point == "tes":
        return by.agg(F.max("transcript_length").alias("ref_pos"))
    if point in ("start_codon", "stop_codon"):
        return by.agg(F.min(f"{point}_pos").cast("long").alias("ref_pos"))
    if point == "last_junction":
        return by.agg(F.max("start_offset").alias("ref_pos"))
    if point == "junction":
        starts = F.array_sort(F.collect_set("start_offset"))
        return by.agg(F.slice(starts, F.lit(2), F.greatest(F.size(starts), F.lit(1))).alias("ref_pos"))
    raise ValueError(f"unknown point {point!r}")
