"""Command line: python -m strandloom.cli COMMAND ... Each command reads files, calls the library and writes text folders."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.plans import annotate as A
from strandloom.plans import group as G
from strandloom.plans import liftover as L
from strandloom.plans import metagene as M
from strandloom.plans import motifs as O
from strandloom.plans import qc as Q
from strandloom.plans import reference as E
from strandloom.plans import refine as N
from strandloom.runtime import cut
from strandloom.sources import gtf, reads, sinks, tables


def columns(text: str) -> list[int]:
    """1-based column numbers."""
    return [int(x) - 1 for x in text.split(",")]


def reference(spark: SparkSession, path: str, folder: str | None) -> DataFrame:
    """The exon reference of a GTF file (kept in `folder` when one is given) or of a Parquet table of exon_reference()."""
    if not path.endswith((".gtf", ".gtf.gz", ".gff", ".gff3")):
        return spark.read.parquet(path)
    build = lambda: E.exon_reference(gtf.read_gtf(spark, path))
    return sinks.cached(spark, path, folder, build) if folder else build()


def refine_rows(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    # the first value of a key; in GFF files keys and values are joined by =
    got = gtf.read_gtf(spark, path, strict=strict)
    pick = lambda k: F.get(F.filter(gtf.pairs(F.col("attributes"), gtf.is_gff(path)), lambda x: x["key"] == k), F.lit(0))["value"]
    got = got.withColumns({c: pick(k) for c, k in {"gene_id": "gene_id", "transcript_id": "transcript_id", "gene_name": "gene_name", "gene_biotype": "gene_biotype", "transcript_biotype": "transcript_biotype", "parent": "Parent", "identifier": "ID", "_gene": "gene"}.items()})
    got = N.with_identity(got).withColumn("gene_name", F.coalesce("gene_name", "_gene")).drop("_gene")
    return got.withColumn("tag", F.try_element_at("attrs", F.lit("tag"))).withColumn("support", F.try_element_at("attrs", F.lit("transcript_support_level"))).withColumnRenamed("_ord", "ord")


def site_table(spark: SparkSession, a) -> DataFrame:
    raw = tables.with_record_id(tables.read_table(spark, a.input, a.header), "record_id")
    return tables.sites(raw, tables.site_columns(raw.drop("record_id"), columns(a.columns)))


def metagene(spark, a):
    s, e = site_table(spark, a), reference(spark, a.reference, a.cache)
    w = a.weight.split(",") if a.weight else []
    if a.point:
        out, lost = M.metagene_point(s, e, a.point, a.before, a.after, a.bins, w)
        print(f"{lost} sites lie outside the span", file=sys.stderr)
    else:
        out = M.metagene(s, e, a.bins, a.split, w, a.region, a.smooth)
    sinks.write_table(out.orderBy("bin").drop("bin"), a.output)


def variants(spark, a) -> DataFrame:
    raw = tables.with_record_id(tables.read_table(spark, a.input, a.header), "site_id")
    names = ("chrom", "pos", "strand", "ref", "alt")
    got = columns(a.columns)
    return raw.select("site_id", *[(F.col(raw.columns[got[i]]) if i < len(got) else F.lit(None).cast("string")).alias(n) for i, n in enumerate(names)])


def annotate(spark, a):
    v = variants(spark, a)
    if a.table:
        hits = A.annotate_table(v, tables.annotation_exons(tables.read_table(spark, a.table, True)), True)
        return sinks.write_table(A.collapse(hits, a.count) if a.collapse else A.unified(hits), a.output)
    e = reference(spark, a.reference, a.cache)
    seqs = None
    if a.fasta:
        at = e.withColumn("_r", F.concat_ws("/", "gene_id", "transcript_id", "start_offset"))
        seqs = A.spliced(e, tables.fetch(tables.read_fasta(spark, a.fasta), at, "_r", "e_start", "e_end"))
    out = A.annotate(v, e, seqs, a.pad, a.strandness, a.all, a.effect)
    sinks.write_table(A.as_effects(out) if a.effect else out, a.output, null="None" if a.effect else "")


def liftover(spark, a):
    exons = tables.annotation_exons(tables.with_record_id(tables.read_table(spark, a.annotation, True), "ord"))
    named = exons.withColumn("start_offset", F.col("offset")).withColumn("end_offset", F.col("offset") + F.col("e_end") - F.col("e_start")).withColumn("transcript_length", F.lit(0)).withColumn("start_codon_pos", F.lit(None).cast("long")).withColumn("stop_codon_pos", F.lit(None).cast("long"))
    tx = A.transcripts(named).join(exons.groupBy("gene_id", "transcript_id").agg(F.min("ord").alias("ord")), ["gene_id", "transcript_id"])
    if a.reads:
        r = reads.read_bam(spark, a.input) if a.input.endswith(".bam") else reads.read_sam(spark, a.input)
        if a.direction == "g2t":
            blocks = Q.read_blocks(r.withColumn("read", F.col("ord"))).select("read", "chrom", "b_start", "b_end")
            picked = L.pick_transcript(blocks, exons).withColumnRenamed("read", "ord")
            r = r.join(picked, "ord")
        out = L.lift_reads(r, tx if a.direction == "t2g" else tx.drop("ord"), "genome" if a.direction == "t2g" else "transcript")
        size = tables.read_faidx(spark, a.faidx) if a.faidx else tx.select(F.col("transcript_id").alias("chrom"), F.aggregate("exons", F.lit(0).cast("long"), lambda s, e: s + e["g_end"] - e["g_start"]).alias("length"))
        return reads.write_sam(out.drop("demoted"), size, a.output, a.sort)
    raw = tables.with_record_id(tables.read_table(spark, a.input, True), "record_id")
    if a.direction == "t2g":
        out = L.table_to_genome(raw.withColumnsRenamed({a.gene: "gene_id", a.position: "tx_pos"}), tx, "record_id")
    else:
        out = L.table_to_transcript(raw.withColumnsRenamed({a.chrom: "chrom", a.position: "pos"}), exons, "record_id")
    sinks.write_table(out.orderBy("record_id").drop("record_id"), a.output)


def motif(spark, a):
    raw = tables.with_record_id(tables.read_table(spark, a.input, a.header), "record_id")
    c = columns(a.columns)
    chunks = tables.read_fasta(spark, a.fasta)
    lengths = chunks.groupBy("chrom").agg(F.max(F.col("offset") + F.length("seq")).alias("length"))
    left, _, right = a.pad.partition(",")
    s = raw.select("record_id", *[F.col(raw.columns[i]).alias(n) for i, n in zip(c, ("chrom", "pos", "strand"), strict=True)])
    sinks.write_table(raw.join(O.site_motifs(s, chunks, lengths, "record_id", int(left), int(right or left), wrap=a.wrap).select("record_id", "motif"), "record_id").orderBy("record_id").drop("record_id"), a.output, a.header)


def logo(spark, a):
    sinks.write_table(O.score_matrix(O.motif_scores(tables.read_motifs(spark, a.input), not a.dna, a.bits, a.share)).orderBy("position"), a.output)


def qc(spark, a):
    r = reads.read_bam(spark, a.input) if a.input.endswith(".bam") else reads.read_sam(spark, a.input)
    rows = refine_rows(spark, a.reference).withColumnRenamed("seqname", "chrom").withColumn("start", F.col("start") - 1)
    table, more = Q.metrics(r, rows, a.unpaired, bool(a.stranded), a.detection)
    sinks.write_metrics(table, f"{a.output}/metrics.tsv")
    sinks.write_table(more["genes"].orderBy("gene_id"), f"{a.output}/genes.tsv")
    sinks.write_table(more["exons"].orderBy("exon_id"), f"{a.output}/exons.tsv")
    sinks.write_table(more["fragments"].groupBy("size").agg(F.count("*").alias("count")).orderBy("size"), f"{a.output}/fragments.tsv")


def coordinate(spark, a):
    raw = tables.read_table(spark, a.input, a.header)
    names = tables.builtin_names(spark, a.style) if a.style else tables.read_table(spark, a.mapping).select(F.col("c0").alias("old"), F.col("c1").alias("new"))
    sinks.write_table(O.rename_chromosomes(raw, raw.columns[columns(a.columns)[0]], names).select(*raw.columns), a.output, a.header)


def refine(spark, a):
    final, lost = N.refine(refine_rows(spark, a.input))
    attrs = gtf.format_attributes([(k, F.col(k)) for k in ("gene_id", "transcript_id", "gene_name", "gene_biotype", "exon_number", "tag")])
    gtf.write_gtf(final.withColumn("source", F.lit("refined")).withColumn("score", F.lit(".")).withColumn("frame", F.lit(".")).withColumn("attributes", attrs), a.output, comments=gtf.read_comments(spark, a.input))
    if a.skipped:
        sinks.write_table(lost.orderBy("gene_id", "start"), a.skipped)


def prepare(spark, a):
    top = N.prepare(refine_rows(spark, a.input, a.strict), "support", a.biotype).orderBy("gene_id")
    left_out = [c for on, cs in ((a.codons, ("start_codon", "stop_codon")), (a.names, ("gene_name",)), (a.kinds, ("transcript_biotype",)), (a.positions, ("transcript_start", "transcript_end"))) for c in cs if not on]
    top = top.withColumn("gene_id", N.sanitized(F.col("gene_id"))) if a.sanitize else top
    sinks.write_table(top.drop(*left_out), a.output)


def export(spark, a):
    e = reference(spark, a.input, None)
    if a.gtf:
        gtf.write_gtf(E.export_gtf(e), a.output)
    else:
        sinks.write_table(E.export_table(e).orderBy("gene_id", "transcript_id"), a.output)


def build(spark, a):
    E.write_reference(reference(spark, a.input, None), a.output)


def listing(spark, a):
    tables.References(a.input).table(spark).show(1000, False)


def group(spark, a):
    raw = tables.read_table(spark, a.input, True)
    kinds = a.biotypes.split(",") if a.biotypes else list(G.KINDS)
    product = F.col("product") if "product" in raw.columns else None
    rows = raw.where(F.col("gene_biotype").isin(*kinds) & (F.col("gene_name") != "")).where(F.col("gene_name").rlike(a.search) if a.search else F.lit(True))
    kind = G.misc_biotype(F.col("gene_biotype"), F.col("gene_name"))
    rows = rows.select("gene_id", G.family(kind, F.col("gene_name"), product).alias("family"), G.settled_biotype(F.col("gene_biotype"), F.col("gene_name")).alias("kind"), F.upper("seq").alias("seq")).where(F.length("seq") <= a.length)
    # unnamed genes go to the family of a named one that holds them or that they hold
    items = cut(rows.withColumn("id", F.xxhash64("gene_id", "family", "kind")))
    placed = G.contained_in(items.select("id", "kind", F.col("family").alias("name"), F.col("gene_id").alias("ord"), "seq", F.col("family").isin(*G.PLACEHOLDERS.values()).alias("placeholder")), "kind")
    target = placed.join(items.select(F.col("id").alias("target"), F.col("family").alias("_to")), "target").select("id", "_to")
    named = items.join(target, "id", "left").select(F.coalesce("_to", "family").alias("family"), "gene_id", "seq")
    clusters = G.cluster_families(named, a.threshold)
    sinks.write_table(clusters.orderBy("family", "cluster_id", "gene_id"), a.output)
    if a.fasta:
        G.fasta_lines(G.admitted(clusters), F.concat_ws("_", "family", "cluster_id"), F.col("consensus")).write.mode("overwrite").text(a.fasta)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandloom")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, run, *options, cols=None):
        q = sub.add_parser(name)
        q.set_defaults(run=run)
        q.add_argument("input")
        q.add_argument("--output", "-o")
        q.add_argument("--header", action="store_true")
        q.add_argument("--cache")
        if cols:
            q.add_argument("--columns", default=cols)
        for names, more in options:
            q.add_argument(*names.split(), **more)

    flag, text = {"action": "store_true"}, {}
    num = lambda n: {"type": int, "default": n}
    ref = ("--reference -r", {"required": True})
    profile = [ref, ("--bins", num(100)), ("--weight", text), ("--smooth", num(1)), ("--split", {"default": "median"}), ("--region", text), ("--before", num(1000)), ("--after", num(1000))]
    add("metagene", metagene, *profile, ("--point", text), cols="1,2,3,6")
    add("metagene-point", metagene, *profile, ("--point", {"required": True}), cols="1,2,3,6")
    site = [("--reference -r", text), ("--table", text), ("--fasta", text), ("--pad", num(10)), ("--strandness", flag), ("--all", flag), ("--collapse", flag), ("--count", flag)]
    for name, eff in (("annotate", False), ("annot", False), ("effect", True)):
        add(name, annotate, *site, ("--effect", {"action": "store_true", "default": eff}), cols="1,2,3,4,5")
    add("liftover", liftover, ("--annotation -a", {"required": True}), ("--direction", {"choices": ["t2g", "g2t"], "default": "t2g"}), ("--reads", flag), ("--sort", flag), ("--faidx", text), ("--gene", {"default": "Chrom"}), ("--chrom", {"default": "Chrom"}), ("--position", {"default": "Pos"}))
    add("motif", motif, ("--fasta", {"required": True}), ("--pad", {"default": "10"}), ("--wrap", flag), cols="1,2,3")
    add("logo", logo, ("--dna", flag), ("--bits", flag), ("--share", flag))
    add("qc", qc, ref, ("--unpaired", flag), ("--stranded", text), ("--detection", num(5)))
    add("coordinate", coordinate, ("--style", {"choices": ["U2E", "E2U"]}), ("--mapping", text), cols="1")
    add("refine", refine, ("--skipped", text))
    add("prepare", prepare, ("--biotype", text), ("--strict", flag), ("--sanitize", flag), *((f"--{c}", {"action": argparse.BooleanOptionalAction, "default": True}) for c in ("codons", "names", "kinds", "positions")))
    add("group", group, ("--biotypes", text), ("--search", text), ("--length", num(300)), ("--threshold", {"type": float, "default": 0.1}), ("--fasta", text))
    add("reference-build", build)
    add("reference-export", export, ("--gtf", flag))
    add("reference-list", listing)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        a.run(spark or SparkSession.builder.appName("strandloom").getOrCreate(), a)
    except (ValueError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
