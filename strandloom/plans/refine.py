"""Cleaning of gene annotations, and the choice of one transcript per gene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.intervals import merge_intervals
from strandloom.runtime import cut

#: Rows here have: ord, seqname, feature, start, end (1-based closed), strand, gene_id, transcript_id, gene_name, gene_biotype, tag.


def prune(rows: DataFrame) -> DataFrame:
    """Rows with sound coordinates and a gene; all but gene rows need a transcript, gene rows have none."""
    kept = rows.where((F.col("start") >= 1) & (F.col("end") >= F.col("start")) & F.col("gene_id").isNotNull() & ((F.col("feature") == "gene") | F.col("transcript_id").isNotNull()))
    return kept.withColumn("transcript_id", F.when(F.col("feature") != "gene", F.col("transcript_id")))


def inconsistent_genes(rows: DataFrame) -> DataFrame:
    """Genes on more than one sequence or strand, with several gene rows, or with rows outside their transcript row."""
    per_gene = rows.groupBy("gene_id").agg(F.count_distinct("seqname").alias("q"), F.count_distinct("strand").alias("s"), F.count_if(F.col("feature") == "gene").alias("g")).where("q > 1 or s > 1 or g > 1")
    tx = F.col("feature") == "transcript"
    per_tx = rows.where("transcript_id is not null").groupBy("gene_id", "transcript_id").agg(F.count_if(tx).alias("n"), F.min(F.when(tx, F.col("start"))).alias("a"), F.max(F.when(tx, F.col("end"))).alias("b"), F.min("start").alias("lo"), F.max("end").alias("hi")).where("n > 1 or lo < a or hi > b")
    return per_gene.select("gene_id").union(per_tx.select("gene_id")).distinct()


def without_genes(rows: DataFrame, genes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of other genes, and those of the rejected ones."""
    return rows.join(genes, "gene_id", "left_anti"), rows.join(genes, "gene_id", "left_semi")


def inferred_kind(rows: DataFrame) -> DataFrame:
    """(gene_id, gene_biotype, gene_name): the only value given, else protein_coding with a CDS, unknown without; the id for a name."""
    b, n = F.collect_set("gene_biotype"), F.collect_set("gene_name")
    g = rows.groupBy("gene_id").agg(b.alias("_b"), n.alias("_n"), F.bool_or(F.col("feature") == "CDS").alias("_c"))
    one = lambda c, other: F.when(F.size(c) == 1, F.get(c, F.lit(0))).otherwise(other)
    return g.select("gene_id", one("_b", F.when(F.col("_c"), "protein_coding").otherwise("unknown")).alias("gene_biotype"), one("_n", F.col("gene_id")).alias("gene_name"))


def bounding_rows(rows: DataFrame, feature: str) -> DataFrame:
    """Missing gene or transcript rows, spanning what belongs to them; a transcript of CDS rows only gets 3 bases more for the stop codon."""
    by = ["gene_id"] if feature == "gene" else ["gene_id", "transcript_id"]
    base = rows if feature == "gene" else rows.where("transcript_id is not null")
    missing = base.join(rows.where(F.col("feature") == feature).select(*by).distinct(), by, "left_anti")
    only_cds = F.bool_and(F.col("feature") == "CDS")
    made = missing.groupBy(*by).agg(F.min_by("seqname", "ord").alias("seqname"), F.min_by("strand", "ord").alias("strand"), F.min("start").alias("start"), F.max("end").alias("end"), only_cds.alias("_c"))
    plus = F.col("strand") != "-"
    return made.withColumn("start", F.when(F.col("_c") & ~plus, F.col("start") - 3).otherwise(F.col("start"))).withColumn("end", F.when(F.col("_c") & plus, F.col("end") + 3).otherwise(F.col("end"))).withColumn("feature", F.lit(feature)).drop("_c")


def merged_rows(rows: DataFrame, feature: str) -> DataFrame:
    """The exon or CDS rows of each transcript, overlapping and adjacent ones merged."""
    half = rows.where(F.col("feature") == feature).withColumn("_s", F.col("start") - 1)
    return merge_intervals(half, ["gene_id", "transcript_id", "seqname", "strand"], "_s", "end").select("gene_id", "transcript_id", "seqname", "strand", (F.col("_s") + 1).alias("start"), "end")


def exon_numbers(exons: DataFrame) -> DataFrame:
    """Exons numbered from 1, from 5' to 3'."""
    return exons.withColumn("exon_number", F.row_number().over(Window.partitionBy("gene_id", "transcript_id").orderBy(F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start")))))


def cds_matches_exons(exons: DataFrame, cds: DataFrame) -> DataFrame:
    """(gene_id, transcript_id, consistent): whether the CDS rows lie in consecutive exons and meet their inner borders."""
    e = exons.select("gene_id", "transcript_id", F.col("start").alias("e_start"), F.col("end").alias("e_end"), "exon_number")
    hit = cds.join(e, ["gene_id", "transcript_id"], "left").withColumn("_in", (F.col("e_start") <= F.col("start")) & (F.col("end") <= F.col("e_end")))
    each = hit.groupBy("gene_id", "transcript_id", "strand", "start", "end").agg(*[F.max(F.when(F.col("_in"), F.col(c))).alias(c) for c in ("exon_number", "e_start", "e_end")])
    w = Window.partitionBy("gene_id", "transcript_id").orderBy("start")
    step = F.abs(F.col("exon_number") - F.lag("exon_number").over(w))
    ok = F.col("exon_number").isNotNull() & F.coalesce(step == 1, F.lit(True)) & F.when(F.lag("start").over(w).isNotNull(), F.col("start") == F.col("e_start")).otherwise(True) & F.when(F.lead("start").over(w).isNotNull(), F.col("end") == F.col("e_end")).otherwise(True)
    return each.withColumn("_ok", F.coalesce(ok, F.lit(False))).groupBy("gene_id", "transcript_id").agg(F.bool_and("_ok").alias("consistent"))


def cds_numbers(exons: DataFrame, cds: DataFrame) -> DataFrame:
    """The CDS rows with the number of the exon that holds them, null where none does."""
    e = exons.select("gene_id", "transcript_id", F.col("start").alias("_a"), F.col("end").alias("_b"), F.col("exon_number").alias("_n"))
    own = cds.columns
    inside = (F.col("_a") <= F.col("start")) & (F.col("end") <= F.col("_b"))
    return cds.join(e, ["gene_id", "transcript_id"], "left").groupBy(*own).agg(F.max(F.when(inside, F.col("_n"))).cast("int").alias("exon_number"))


def derived_codons(cds: DataFrame) -> DataFrame:
    """Start and stop codon rows from the CDS's outer borders; the stop codon lies beyond the CDS."""
    g = cds.groupBy("gene_id", "transcript_id", "seqname", "strand").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    minus = F.col("strand") == "-"
    start = F.struct(F.lit("start_codon").alias("feature"), F.when(minus, F.col("b") - 2).otherwise(F.col("a")).alias("start"), F.when(minus, F.col("b")).otherwise(F.col("a") + 2).alias("end"))
    stop = F.struct(F.lit("stop_codon").alias("feature"), F.when(minus, F.col("a") - 3).otherwise(F.col("b") + 1).alias("start"), F.when(minus, F.col("a") - 1).otherwise(F.col("b") + 3).alias("end"))
    return g.select("gene_id", "transcript_id", "seqname", "strand", F.explode(F.array(start, stop)).alias("x")).select("gene_id", "transcript_id", "seqname", "strand", "x.*")


def canonical_transcripts(rows: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """(gene_id, transcript_id): listed and coding, else listed, else coding, else any; then the longest, then the first."""
    tx = rows.where("transcript_id is not null").groupBy("gene_id", "transcript_id").agg(F.bool_or(F.col("feature") == "CDS").alias("coding"), F.coalesce(F.sum(F.when(F.col("feature") == "exon", F.col("end") - F.col("start") + 1)), F.lit(0)).alias("length"), F.min("ord").alias("ord"))
    if listed is not None:
        tx = tx.join(listed.select("transcript_id").distinct().withColumn("listed", F.lit(True)), "transcript_id", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    else:
        tx = tx.withColumn("listed", F.lit(False))
    tier = F.when(F.col("listed") & F.col("coding"), 0).when(F.col("listed"), 1).when(F.col("coding"), 2).otherwise(3)
    return tx.groupBy("gene_id").agg(F.min_by("transcript_id", F.struct(tier, -F.col("length"), "ord")).alias("transcript_id"))


def with_canonical_tag(tag: Column) -> Column:
    """Ensembl_canonical added to the tags joined by `; ` when it isn't there."""
    return F.when(tag.isNull() | (tag == ""), "Ensembl_canonical").when(F.array_contains(F.split(tag, "; "), "Ensembl_canonical"), tag).otherwise(F.concat(tag, F.lit("; Ensembl_canonical")))


def unique_names(df: DataFrame, name: str, order: str, suffix: Column) -> DataFrame:
    """The second and later rows of a name, in order, get the suffix; rows without name stay, each for itself."""
    own = F.coalesce(F.col(name), F.concat(F.lit("\x00"), F.col(order).cast("string")))
    n = F.row_number().over(Window.partitionBy(own).orderBy(order))
    return df.withColumn("_n", n).withColumn(name, F.when(F.col("_n") > 1, F.concat(F.col(name), F.lit("_"), suffix)).otherwise(F.col(name))).drop("_n")


def feature_combinations(rows: DataFrame) -> DataFrame:
    """(features, count, ratio): which kinds of rows genes have."""
    g = rows.groupBy("gene_id").agg(F.array_join(F.array_sort(F.collect_set("feature")), ",").alias("features")).groupBy("features").agg(F.count("*").alias("count"))
    return g.withColumn("ratio", F.round(F.col("count") / F.sum("count").over(Window.partitionBy(F.lit(0))), 6))  # one row per combination


def refine(rows: DataFrame, listed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The cleaned rows, and those of rejected genes (which are rejected as a whole)."""
    pruned = cut(prune(rows))  # read by every step
    good, rejected = without_genes(pruned, cut(inconsistent_genes(pruned)))
    parts = ["gene_id", "transcript_id", "seqname", "strand", "start", "end", "feature"]
    exons = merged_rows(good, "exon")
    cds = cut(merged_rows(good, "CDS"))
    from_cds = cds.join(exons.select("gene_id", "transcript_id").distinct(), ["gene_id", "transcript_id"], "left_anti")
    exons = cut(exon_numbers(exons.unionByName(from_cds)))
    wrong = cds_matches_exons(exons, cds).where("not consistent").select("gene_id").distinct()
    have = good.where(F.col("feature").isin("start_codon", "stop_codon"))
    derived = derived_codons(cds).join(have.select("gene_id", "transcript_id", "feature").distinct(), ["gene_id", "transcript_id", "feature"], "left_anti")
    whole = good.where(F.col("feature").isin("gene", "transcript")).select(*parts)
    out = whole.unionByName(bounding_rows(good, "gene").withColumn("transcript_id", F.lit(None).cast("string")).select(*parts)).unionByName(bounding_rows(good, "transcript").select(*parts))
    out = out.withColumn("exon_number", F.lit(None).cast("int"))
    out = out.unionByName(exons.withColumn("feature", F.lit("exon")).select(*parts, "exon_number"))
    out = out.unionByName(cds_numbers(exons, cds.withColumn("feature", F.lit("CDS")).select(*parts)))
    out = out.unionByName(have.select(*parts).unionByName(derived.select(*parts)).withColumn("exon_number", F.lit(None).cast("int")))
    kept, lost = without_genes(out, wrong)
    order = good.groupBy("gene_id").agg(F.min("ord").alias("_ord"))
    names = unique_names(inferred_kind(good).join(order, "gene_id"), "gene_name", "_ord", F.col("gene_id")).drop("_ord")
    tags = canonical_transcripts(good, listed).withColumn("tag", F.lit("Ensembl_canonical"))
    final = kept.join(names, "gene_id").join(tags, ["gene_id", "transcript_id"], "left")
    return final, rejected.select(*parts).unionByName(lost.select(*parts))


def rank_transcript(tag: Column, support: Column, transcript_id: Column, length: Column) -> Column:
    """struct<a, b>, smaller is better: MANE, canonical, basic; then the support level's digit; then a numbered id, by `.` or `-`; then the length."""
    level = F.regexp_extract(F.coalesce(support, F.lit("")), r"^(\d)", 1)
    s = lambda a, b: F.struct(F.lit(a).cast("long").alias("a"), (b if isinstance(b, Column) else F.lit(b)).cast("long").alias("b"))
    has = lambda t: F.array_contains(F.split(F.coalesce(tag, F.lit("")), "; "), t)
    dot, dash = (F.regexp_extract(transcript_id, p, 1) for p in (r"\.(\d+)$", r"-(\d+)$"))
    fallback = F.when(dot != "", s(2, dot.try_cast("bigint"))).when(dash != "", s(3, dash.try_cast("bigint"))).otherwise(s(4, F.when(length >= 100000, 100001).otherwise(100100 - length)))
    return F.when(has("MANE_Select"), s(0, 0)).when(has("Ensembl_canonical"), s(0, 1)).when(has("basic"), s(0, 2)).when(F.coalesce(tag, F.lit("")) != "", fallback).when(level != "", s(1, level.try_cast("bigint"))).otherwise(fallback)


def conflicting_transcripts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Transcripts whose rows disagree in any of the columns, nulls and empty texts apart."""
    aggs = [F.count_distinct(F.when(F.col(c) != "", F.col(c))).alias(f"_{c}") for c in columns]
    bad = F.lit(False)
    for c in columns:
        bad = bad | (F.col(f"_{c}") > 1)
    return rows.groupBy("gene_id", "transcript_id").agg(*aggs).where(bad).select("gene_id", "transcript_id")


def gff_transcript(identifier: Column) -> Column:
    """The transcript in an exon's ID: what stands before the last `.exon.`, `.exon` or `-`, a leading `exon-` or `exon` dropped in the last case."""
    cut = lambda p: F.regexp_extract(identifier, p, 1)
    dash = F.regexp_replace(cut(r"^(.*)-"), "^exon-?", "")
    return F.when(identifier.contains(".exon."), cut(r"^(.*)\.exon\.")).when(identifier.contains(".exon"), cut(r"^(.*)\.exon")).when(identifier.contains("-"), dash)


def with_identity(rows: DataFrame) -> DataFrame:
    """gene_id and transcript_id of rows that have attributes `parent` and `identifier` instead: the parent, and what the ID names."""
    bare = F.col("gene_id").isNull() & F.col("transcript_id").isNull() & F.col("parent").isNotNull() & F.col("identifier").isNotNull()
    tx = gff_transcript(F.col("identifier"))
    return rows.withColumn("_bare", bare & tx.isNotNull()).withColumn("gene_id", F.when(F.col("_bare"), F.col("parent")).otherwise(F.col("gene_id"))).withColumn("transcript_id", F.when(F.col("_bare"), tx).otherwise(F.col("transcript_id"))).drop("_bare", "parent", "identifier")


def inherited_biotype(rows: DataFrame) -> DataFrame:
    """transcript_biotype, where it is missing or `primary_transcript`, from the gene row's gene_biotype (one that isn't empty)."""
    genes = rows.where((F.col("feature") == "gene") & (F.col("gene_biotype") != "")).groupBy("gene_id").agg(F.max_by("gene_biotype", "ord").alias("_kind"))
    own = F.coalesce("transcript_biotype", F.lit("primary_transcript"))
    return rows.join(genes, "gene_id", "left").withColumn("transcript_biotype", F.when(F.col("_kind").isNotNull() & (own == "primary_transcript"), F.col("_kind")).otherwise(F.col("transcript_biotype"))).drop("_kind")


def prepare(rows: DataFrame, support: str | None = None, biotype: str | None = None) -> DataFrame:
    """One row per gene: the top transcript with its spans from 5' to 3', the codons' starts and the bounding box, and its
    biotype where rows have transcript_biotype (`biotype` keeps the genes whose top transcript is of this kind).

    Transcripts whose rows disagree on sequence, strand, gene name or biotype are left out; ties go to the first row.
    """
    typed = "transcript_biotype" in rows.columns
    rows = inherited_biotype(rows).where(F.col("feature").isin("exon", "start_codon", "stop_codon")) if typed else rows
    bad = conflicting_transcripts(rows.where("transcript_id is not null"), ["seqname", "strand", "gene_name", *(["transcript_biotype"] if typed else [])])
    use = rows.where("transcript_id is not null and gene_id is not null").join(bad, ["gene_id", "transcript_id"], "left_anti")
    sup = F.col(support) if support else F.lit(None).cast("string")
    is_exon = F.col("feature") == "exon"
    minus = F.col("strand") == "-"
    span = F.struct(F.when(minus, -F.col("start")).otherwise(F.col("start")).alias("k"), F.concat(F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")).alias("s"))
    tx = use.groupBy("gene_id", "transcript_id").agg(
        F.min_by("seqname", "ord").alias("chrom"), F.min_by("strand", "ord").alias("strand"), F.min_by("gene_name", "ord").alias("gene_name"), F.max_by("tag", "ord").alias("tag"), F.max_by(sup, "ord").alias("support"), F.min("ord").alias("ord"),
        F.array_join(F.transform(F.array_sort(F.collect_set(F.when(is_exon, span))), lambda x: x["s"]), ",").alias("spans"), F.coalesce(F.sum(F.when(is_exon, F.col("end") - F.col("start") + 1)), F.lit(0)).alias("length"),
        F.min(F.when(F.col("feature") == "start_codon", F.col("start"))).alias("start_codon"), F.min(F.when(F.col("feature") == "stop_codon", F.col("start"))).alias("stop_codon"), F.min(F.when(is_exon, F.col("start"))).alias("transcript_start"), F.max(F.when(is_exon, F.col("end"))).alias("transcript_end"),
        *([F.min_by("transcript_biotype", "ord").alias("transcript_biotype")] if typed else []),
    ).where("spans <> ''")
    ranked = tx.withColumn("_r", rank_transcript(F.col("tag"), F.col("support"), F.col("transcript_id"), F.col("length")))
    cols = ["transcript_id", "chrom", "strand", "spans", "start_codon", "stop_codon", "gene_name", "transcript_start", "transcript_end", *(["transcript_biotype"] if typed else [])]
    top = ranked.groupBy("gene_id").agg(F.min_by(F.struct(*cols), F.struct("_r", "ord")).alias("t")).select("gene_id", "t.*")
    return top.where(F.col("transcript_biotype") == biotype) if biotype else top


def sanitized(name: Column) -> Column:
    """A sequence name of allowed signs; a changed one gets the first eight signs of its MD5."""
    # The signs a name may have, at its start and behind it.
    clean = F.concat(F.regexp_replace(name.substr(1, 1), r"[^0-9A-Za-z!#$%&+./:;?@^_|~-]", "_"), F.regexp_replace(name.substr(F.lit(2), F.length(name)), r"[^0-9A-Za-z!#$%&*+./:;=?@^_|~-]", "_"))
    return F.when(name.isNull() | (name == "") | (clean == name), name).otherwise(F.concat(clean, F.lit("_"), F.substring(F.md5(name.cast("binary")), 1, 8)))
