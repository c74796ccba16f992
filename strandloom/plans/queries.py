"""Queries on the genomics operators over the domain tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
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
from strandloom.plans import reference as E
from strandloom.plans import refine as N
from strandloom.runtime import norm, table
from strandloom.sources import gtf, tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ---- inputs -----------------------------------------------------------------------------------------

BASE = """with ex0 as (select upper(trim(gene_id)) gene_id, upper(trim(transcript_id)) transcript_id, chromosome chrom, strand, start e_start, "end" e_end, min(transcript_level) lv, min(start_codon_pos) sc, min(stop_codon_pos) st, min(gene_name) gn, min(gene_biotype) gb
  from exon_ref where gene_id is not null and transcript_id is not null and chromosome is not null and start < "end" and strand in ('+', '-') group by 1, 2, 3, 4, 5, 6),
ex1 as (select gene_id, transcript_id, chrom, strand, e_start, e_end, min(lv) over t transcript_level, cast(min(sc) over t as bigint) start_codon_pos, cast(min(st) over t as bigint) stop_codon_pos, min(gn) over t gene_name, min(gb) over t gene_biotype,
  cast(sum(e_end - e_start) over t as bigint) transcript_length, cast(sum(e_end - e_start) over (partition by gene_id, transcript_id order by case when strand = '-' then -e_start else e_start end, e_end, chrom, strand rows unbounded preceding) as bigint) end_offset
  from ex0 window t as (partition by gene_id, transcript_id)),
ex as (select *, end_offset - (e_end - e_start) start_offset from ex1),
si as (select annotation_id site_id, min(chrom) chrom, min(pos) pos, min(transcript_strand) strand from annotation where pos is not null and chrom is not null group by annotation_id),
best as (select gene_id, transcript_id from (select gene_id, transcript_id, row_number() over (partition by gene_id order by transcript_level nulls last, transcript_length desc, transcript_id) n from (select distinct gene_id, transcript_id, transcript_level, transcript_length from ex)) where n = 1),
bx as (select * from ex where transcript_id in (select transcript_id from best)),
ma as (select s.site_id, s.chrom, s.strand, b.gene_id, b.transcript_id, b.transcript_length, b.start_codon_pos, b.stop_codon_pos,
  greatest(least(case when s.strand = '-' then e_end - pos else pos - 1 - e_start end, e_end - e_start), 0) + start_offset transcript_start, greatest(least(case when s.strand = '-' then e_end - pos + 1 else pos - e_start end, e_end - e_start), 0) + start_offset transcript_end
  from si s left join bx b on s.chrom = b.chrom and s.strand = b.strand and pos - 1 < e_end and e_start < pos),
mr as (select *, case when transcript_start is null or start_codon_pos is null or stop_codon_pos is null then 'None' when transcript_start < start_codon_pos then '5UTR' when transcript_start >= stop_codon_pos + 3 then '3UTR' else 'CDS' end feature_type from ma),
tx as (select gene_id, transcript_id, chrom, strand, min(e_start) lo, max(e_end) hi, min(start_codon_pos) start_codon_pos, min(stop_codon_pos) stop_codon_pos, max(transcript_length) transcript_length from ex group by 1, 2, 3, 4),
fa as (select *, regexp_extract_all(attributes, '(\\w+)\\s+"(.*?)"(?:;|$)', 1) k, regexp_extract_all(attributes, '(\\w+)\\s+"(.*?)"(?:;|$)', 2) v from feature),
fe as (select feature_id ord, upper(trim(seqname)) seqname, feature, start, "end", strand, upper(trim(v[list_position(k, 'gene_id')])) g0, upper(trim(transcript_id)) transcript_id, v[list_position(k, 'gene_name')] n0, v[list_position(k, 'gene_biotype')] b0, v[list_position(k, 'tag')] t0 from fa),
fr as (select ord, seqname, feature, start, "end", strand, g0 gene_id, transcript_id, n0 gene_name, b0 gene_biotype, t0 tag from fe),
pr as (select ord, seqname, feature, start, "end", strand, gene_id, case when feature <> 'gene' then transcript_id end transcript_id, gene_name, gene_biotype, tag from fr where start >= 1 and "end" >= start and gene_id is not null and (feature = 'gene' or transcript_id is not null)),
bl0 as (select annotation_id, min(chrom) chrom, min(pos) - 1 p from annotation where pos is not null and chrom is not null group by annotation_id),
bl as (select annotation_id "read", chrom, 0 block_no, p b_start, p + 20 b_end from bl0 union all select annotation_id, chrom, 1, p + 20 + annotation_id % 500, p + 50 + annotation_id % 500 from bl0 where annotation_id % 3 = 0),
fx as (select b.*, e.e_start, e.e_end, e.gene_id, e.transcript_id, e.e_start <= b_start and b_end <= e.e_end "full" from bl b join ex e on b.chrom = e.chrom and b_start < e.e_end and e.e_start < b_end),
bt as (select "read", count(*) n from bl group by 1),
un as (select f."read", gene_id from fx f join bt on bt."read" = f."read" where "full" group by 1, 2, n having count(distinct block_no) = n),
hist as (select case when feature_type = '5UTR' then transcript_start / greatest(start_codon_pos, 1) * 0.2 when feature_type = 'CDS' then 0.2 + (transcript_start - start_codon_pos) / greatest(stop_codon_pos + 3 - start_codon_pos, 1) * 0.5
  when feature_type = '3UTR' then 0.2 + 0.5 + (transcript_start - stop_codon_pos - 3) / greatest(transcript_length - stop_codon_pos - 3, 1) * 0.3 end x, site_id % 7 w from mr where feature_type <> 'None') """


def exons(spark, sf: str) -> DataFrame:
    """The exon reference of exon_ref: normalised, repeats removed, offsets and lengths computed from the exons."""
    raw = table(spark, sf, "exon_ref").where(F.col("gene_id").isNotNull() & F.col("transcript_id").isNotNull() & F.col("chromosome").isNotNull() & (F.col("start") < F.col("end")) & F.col("strand").isin("+", "-"))
    keys = [norm("gene_id").alias("gene_id"), norm("transcript_id").alias("transcript_id"), F.col("chromosome").alias("chrom"), "strand", F.col("start").alias("e_start"), F.col("end").alias("e_end")]
    rest = ("transcript_level", "start_codon_pos", "stop_codon_pos", "gene_name", "gene_biotype")
    one = raw.groupBy(*keys).agg(*[F.min(c).alias(c) for c in rest])
    tx = Window.partitionBy("gene_id", "transcript_id")
    shared = one.withColumns({c: F.min(c).over(tx) for c in rest}).withColumn("start_codon_pos", F.col("start_codon_pos").cast("long")).withColumn("stop_codon_pos", F.col("stop_codon_pos").cast("long"))
    return E.with_offsets(shared)


def one_row(e: DataFrame, *by: str) -> DataFrame:
    """Of each `by` the exons of one gene, chromosome and strand, the first in this order; offsets and lengths are of these exons."""
    first = e.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min(F.struct("gene_id", "chrom", "strand")).alias("_first"))
    same = [F.col(c) == F.col(f"_{c}") for c in by] + [F.col(c) == F.col(f"_first.{c}") for c in ("gene_id", "chrom", "strand")]
    return E.with_offsets(e.join(first, same, "left_semi"))


def sites(spark, sf: str) -> DataFrame:
    """The sites of annotation, one row each: site_id, chrom, pos (1-based), strand."""
    a = table(spark, sf, "annotation").where("pos is not null and chrom is not null")
    return a.groupBy(F.col("annotation_id").alias("site_id")).agg(F.min("chrom").alias("chrom"), F.min("pos").alias("pos"), F.min("transcript_strand").alias("strand"))


def spans(spark, sf: str) -> DataFrame:
    return sites(spark, sf).withColumn("start", F.col("pos") - 1).withColumn("end", F.col("pos")).drop("pos")


def mapped(spark, sf: str) -> DataFrame:
    return M.map_to_transcripts(spans(spark, sf), exons(spark, sf), "site_id")


def with_region(df: DataFrame) -> DataFrame:
    return df.withColumn("feature_type", M.region(M.middle(F.col("transcript_start"), F.col("transcript_end")), F.col("start_codon_pos"), F.col("stop_codon_pos")))


def gtf_rows(spark, sf: str) -> DataFrame:
    f = gtf.with_values(table(spark, sf, "feature").withColumnRenamed("transcript_id", "tx"), "attributes", ("gene_id", "gene_name", "gene_biotype", "tag"))
    return f.select(F.col("feature_id").alias("ord"), norm("seqname").alias("seqname"), "feature", "start", "end", "strand", norm("gene_id").alias("gene_id"), norm("tx").alias("transcript_id"), "gene_name", "gene_biotype", "tag")


def pruned(spark, sf: str) -> DataFrame:
    return N.prune(gtf_rows(spark, sf))


def blocks(spark, sf: str) -> DataFrame:
    """Reads made from annotation rows: 20 bases, and for every third 30 more behind a gap."""
    a = table(spark, sf, "annotation").where("pos is not null and chrom is not null").groupBy(F.col("annotation_id").alias("ord")).agg(F.min("chrom").alias("rname"), (F.min("pos") - 1).alias("pos"))
    cigar = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("20M"), (F.col("ord") % 500).cast("string"), F.lit("N30M"))).otherwise("20M")
    return Q.read_blocks(a.withColumn("read", F.col("ord")).withColumn("flag", F.lit(0)).withColumn("cigar", cigar))


def cover(spark, sf: str) -> tuple[DataFrame, DataFrame]:
    b = blocks(spark, sf)
    e = exons(spark, sf).withColumn("exon_id", F.concat_ws(":", "transcript_id", "e_start"))
    return b, Q.full_cover(b, e.select("chrom", "e_start", "e_end", "exon_id", "gene_id"))


# ---- joins ------------------------------------------------------------------------------------------


@query("c00_overlap_pairs", BASE + "select site_id, gene_id, transcript_id, e_start from si join ex on si.chrom = ex.chrom and si.strand = ex.strand and e_start < pos and pos <= e_end")
def c00(s, d):
    return I.overlap_pairs(sites(s, d).withColumn("p", F.col("pos") - 1), exons(s, d), ["chrom", "strand"], ("p", None), ("e_start", "e_end"), ["site_id"]).select("site_id", "gene_id", "transcript_id", "e_start")


@query("c02_site_best_tx", BASE + "select site_id, gene_id, transcript_id, transcript_start, transcript_end from ma")
def c02(s, d):
    return mapped(s, d).select("site_id", "gene_id", "transcript_id", "transcript_start", "transcript_end")


@query(
    "c03_map_to_local",
    BASE + """, q as (select site_id, chrom, strand, pos - 25 s, pos + 25 e from si where strand in ('+', '-'))
    select site_id, transcript_id, case when b.strand = '-' then e_end - least(e, e_end) else greatest(s, e_start) - e_start end + start_offset local_start, case when b.strand = '-' then e_end - greatest(s, e_start) else least(e, e_end) - e_start end + start_offset local_end,
    case when q.strand = b.strand then '+' else '-' end local_strand from q join bx b on q.chrom = b.chrom and s < e_end and e_start < e""",
)
def c03(s, d):
    e = exons(s, d)
    ref = e.join(E.best_transcripts(e).select("transcript_id").distinct(), "transcript_id", "left_semi").withColumn("ref", F.concat_ws("/", "gene_id", "transcript_id")).select("ref", "transcript_id", "chrom", F.col("e_start").alias("r_start"), F.col("e_end").alias("r_end"), F.col("strand").alias("r_strand"))
    q = sites(s, d).where(F.col("strand").isin("+", "-")).select("site_id", "chrom", "strand", (F.col("pos") - 25).alias("start"), (F.col("pos") + 25).alias("end"))
    return M.map_to_local(q, ref, "ref", "site_id").select("site_id", "transcript_id", "local_start", "local_end", "local_strand")


@query(
    "c04_best_overlap",
    BASE + """, q as (select ord, seqname chrom, start - 1 s, "end" e from fr where feature = 'CDS' and start <= "end"), r as (select distinct chrom, e_start, e_end from ex),
    p as (select ord, e_start, e_end, least(e, e_end) - greatest(s, e_start) o from q join r on q.chrom = r.chrom and s < e_end and e_start < e)
    select ord, e_start, e_end, o overlap from (select *, row_number() over (partition by ord order by o desc, e_start, e_end) n from p) where n = 1""",
)
def c04(s, d):
    q = gtf_rows(s, d).where("feature = 'CDS' and start <= end").select("ord", F.col("seqname").alias("chrom"), (F.col("start") - 1).alias("s"), F.col("end").alias("e"))
    return I.best_overlap(q, exons(s, d).select("chrom", "e_start", "e_end").distinct(), ["chrom"], ("s", "e"), ("e_start", "e_end"), "ord", ["e_start", "e_end"]).select("ord", "e_start", "e_end", "overlap")


@query("c05_gene_body_hits", BASE + "select site_id, count(gene_id) hits, min(gene_id) first_gene from si left join tx on si.chrom = tx.chrom and lo < pos and pos <= hi group by site_id")
def c05(s, d):
    hit = I.overlap_join(sites(s, d).withColumn("p", F.col("pos") - 1).drop("strand"), A.transcripts(exons(s, d)).select("chrom", "lo", "hi", "gene_id"), ["chrom"], ("p", None), ("lo", "hi"), "site_id", "left")
    return hit.groupBy("site_id").agg(F.count("gene_id").alias("hits"), F.min("gene_id").alias("first_gene"))


TABLE = BASE + """, sp as (select gene_id, transcript_id, min(chrom) chrom, min(strand) strand from ex group by 1, 2),
ax as (select e.gene_id, e.transcript_id, sp.chrom, sp.strand, e_start, e_end, start_offset o, row_number() over (partition by e.gene_id, e.transcript_id order by start_offset) - 1 exon_no from ex e join sp on sp.gene_id = e.gene_id and sp.transcript_id = e.transcript_id),
hits as (select site_id, coalesce(gene_id, '.') gene_id, coalesce(transcript_id, '.') transcript_id, coalesce(cast(case when si.strand = '-' then e_end - pos else pos - 1 - e_start end + o as varchar), '.') transcript_pos from si left join ax on si.chrom = ax.chrom and si.strand = ax.strand and e_start < pos and pos <= e_end) """


def exported(s, d):
    return tables.annotation_exons(E.export_table(exons(s, d)))


@query("c06_stranded_hits", TABLE + "select * from hits")
def c06(s, d):
    return A.annotate_table(sites(s, d), exported(s, d)).select("site_id", "gene_id", "transcript_id", "transcript_pos")


@query("b11_unified_table", TABLE + "select site_id, chrom, pos, strand, gene_id, transcript_id, transcript_pos, " + ", ".join(f"'' {c}" for c in A.COLUMNS[3:]) + " from (select h.*, si.chrom, si.pos, si.strand from hits h join si on si.site_id = h.site_id)")
def b11(s, d):
    return A.unified(A.annotate_table(sites(s, d), exported(s, d)))


@query("b10_collapsed_hits", TABLE + "select site_id, string_agg(gene_id, ',' order by gene_id, transcript_id, transcript_pos) gene_id, string_agg(transcript_id, ',' order by gene_id, transcript_id, transcript_pos) transcript_id, string_agg(transcript_pos, ',' order by gene_id, transcript_id, transcript_pos) transcript_pos, cast(sum(case when gene_id <> '.' then 1 else 0 end) as int) hits from hits group by site_id")
def b10(s, d):
    return A.collapse(A.annotate_table(sites(s, d), exported(s, d)), True)


@query("c07_block_full_cover", BASE + 'select "read", block_no, gene_id, transcript_id, e_start, "full" from fx')
def c07(s, d):
    return cover(s, d)[1].select("read", "block_no", "gene_id", F.split("exon_id", ":")[0].alias("transcript_id"), "e_start", "full")


@query(
    "c08_pick_transcript",
    BASE + """, o as (select transcript_id, row_number() over (order by transcript_id) i from (select distinct transcript_id from ex)), u as (select distinct chrom, transcript_id, e_start, e_end from ex),
    k as (select b."read", u.transcript_id, block_no, max(e_start <= b_start and b_end <= e_end) h, sum(least(b_end, e_end) - greatest(b_start, e_start)) n from bl b join u on b.chrom = u.chrom and b_start < e_end and e_start < b_end group by 1, 2, 3),
    t as (select k."read", k.transcript_id, i, sum(n) + case when sum(case when h then 1 else 0 end) = max(bt.n_) then 1000000000 else 0 end s from k join (select "read", n n_ from bt) bt on bt."read" = k."read" join o on o.transcript_id = k.transcript_id group by 1, 2, 3)
    select "read", transcript_id from (select *, row_number() over (partition by "read" order by s desc, i) n from t) where n = 1""",
)
def c08(s, d):
    e = exons(s, d).select("chrom", "transcript_id", "e_start", "e_end").distinct()
    # the annotation's order is that of the ids here: the id itself ranks, in place of a number
    got = L.pick_transcript(blocks(s, d).select("read", "chrom", "b_start", "b_end"), e.withColumn("ord", F.expr("cast(substring(transcript_id, 4) as bigint)")))
    return got


@query("c09_key_alias", BASE + ", u as (select distinct gene_id, transcript_id from ex), s1 as (select gene_id from u group by 1 having count(*) = 1) select transcript_id k, transcript_id, gene_id from u union all select gene_id, transcript_id, gene_id from u where gene_id in (select gene_id from s1)")
def c09(s, d):
    return L.keyed_transcripts(exons(s, d).select("gene_id", "transcript_id").distinct()).select(F.col("key").alias("k"), "transcript_id", "gene_id")


@query(
    "c10_tx_to_genome",
    BASE + """, fs as (select gene_id, transcript_id, min(row(chrom, strand)) k from ex group by 1, 2), e1 as (select ex.gene_id, ex.transcript_id, chrom, strand, e_start, e_end from ex join fs on fs.gene_id = ex.gene_id and fs.transcript_id = ex.transcript_id and row(chrom, strand) = k),
    e2 as (select *, cast(sum(e_end - e_start) over (partition by gene_id, transcript_id order by case when strand = '-' then -e_start else e_start end, e_end rows unbounded preceding) as bigint) end_offset from e1), e as (select *, end_offset - (e_end - e_start) start_offset from e2),
    f as (select gene_id, min(transcript_id) transcript_id from ex group by 1), q as (select annotation_id, min(upper(trim(gene_id))) gene_id, min(transcript_pos) t from annotation where gene_id is not null group by 1)
    select annotation_id, e.chrom, case when e.strand = '-' then e_end - (t - 1 - start_offset) else e_start + t - start_offset end pos from q left join f on f.gene_id = q.gene_id left join e on e.gene_id = f.gene_id and e.transcript_id = f.transcript_id and start_offset <= t - 1 and t - 1 < end_offset""",
)
def c10(s, d):
    q = table(s, d, "annotation").where("gene_id is not null").groupBy("annotation_id").agg(F.min(norm("gene_id")).alias("gene_id"), F.min("transcript_pos").alias("t"))
    sound = A.transcripts(one_row(exons(s, d), "gene_id", "transcript_id"))
    return L.table_to_genome(q.withColumn("tx_pos", F.col("t").cast("string")), sound.withColumn("ord", F.col("transcript_id")), "annotation_id").select("annotation_id", "chrom", "pos")


@query(
    "c11_genome_to_tx_first",
    BASE + """, p as (select site_id, gene_id, transcript_id, case when ex.strand = '-' then e_end - pos else pos - 1 - e_start end + start_offset + 1 tx_pos, row_number() over (partition by site_id order by transcript_id, gene_id, start_offset) n from si join ex on si.chrom = ex.chrom and e_start < pos and pos <= e_end)
    select si.site_id, gene_id, transcript_id, tx_pos from si left join p on p.site_id = si.site_id and n = 1""",
)
def c11(s, d):
    e = exons(s, d).select("chrom", "strand", "e_start", "e_end", F.col("start_offset").alias("offset"), "gene_id", "transcript_id", F.struct("transcript_id", "gene_id").alias("ord"), F.col("start_offset").alias("exon_no"))
    return L.table_to_transcript(sites(s, d).select("site_id", "chrom", F.col("pos").cast("string").alias("pos")), e, "site_id").select("site_id", "gene_id", "transcript_id", "tx_pos")


@query(
    "c12_nearest_junction",
    BASE + """, j0 as (select transcript_id, start_offset x from bx group by 1, 2), j as (select * from j0 where x > (select min(x) from j0 k where k.transcript_id = j0.transcript_id)),
    p as (select site_id, gene_id, m.transcript_id, transcript_start, x, row_number() over (partition by site_id, gene_id, m.transcript_id, transcript_start order by abs(transcript_start - x), x) n from (select distinct site_id, gene_id, transcript_id, transcript_start from ma) m join j on j.transcript_id = m.transcript_id)
    select site_id, gene_id, transcript_id, transcript_start - x distance from p where n = 1""",
)
def c12(s, d):
    e = exons(s, d)
    best = e.join(E.best_transcripts(e).select("transcript_id").distinct(), "transcript_id", "left_semi")
    m = mapped(s, d).select("site_id", "gene_id", "transcript_id", "transcript_start", "transcript_end").distinct()
    return M.with_distance(m, best, "junction").select("site_id", "gene_id", "transcript_id", "distance")


@query("c16_semi_best", BASE + "select gene_id, transcript_id, e_start, e_end from bx")
def c16(s, d):
    e = exons(s, d)
    return e.join(E.best_transcripts(e).select("transcript_id").distinct(), "transcript_id", "left_semi").select("gene_id", "transcript_id", "e_start", "e_end")


@query("c17_chrom_rename", "select feature_id, coalesce(b.name, upper(trim(seqname))) seqname from feature f left join (select upper(trim(alias)) a, min(name) name from chrom_alias group by 1) b on b.a = upper(trim(f.seqname))")
def c17(s, d):
    names = table(s, d, "chrom_alias").groupBy(norm("alias").alias("old")).agg(F.min("name").alias("new"))
    return O.rename_chromosomes(table(s, d, "feature").select("feature_id", norm("seqname").alias("seqname")), "seqname", names)


@query("c20_contig_anti", "select distinct upper(trim(seqname)) seqname from feature where seqname is not null and upper(trim(seqname)) not in (select upper(trim(name)) from contig)")
def c20(s, d):
    have = table(s, d, "contig").select(norm("name").alias("seqname"))
    return table(s, d, "feature").select(norm("seqname").alias("seqname")).where("seqname is not null").distinct().join(have, "seqname", "left_anti")


MOTIFS = "mo as (select annotation_id idx, min(upper(transcript_motif)) motif, cast(annotation_id % 5 as double) w, min(region) region from annotation where transcript_motif is not null and length(transcript_motif) = 21 group by annotation_id) "


def motifs(s, d):
    a = table(s, d, "annotation").where("transcript_motif is not null and length(transcript_motif) = 21")
    return a.groupBy(F.col("annotation_id").alias("idx")).agg(F.min(F.upper("transcript_motif")).alias("motif"), F.min("region").alias("region")).withColumn("weight", (F.col("idx") % 5).cast("double"))


@query(
    "c19_contained",
    "with " + MOTIFS + """, u as (select region, motif, min(idx) id from mo group by 1, 2), i as (select id * 2 id, region, substr(motif, cast(1 + id % 5 as bigint), 16) seq, true p, 'N' nm from u union all select id * 2 + 1, region, motif, false, 'N' || cast(id % 11 as varchar) from u),
    c as (select a.id, b.id target, b.nm from i a join i b on a.region = b.region and not b.p and a.p and contains(b.seq, a.seq) and length(a.seq) > 0.5 * length(b.seq))
    select id, target from (select *, row_number() over (partition by id order by nm, target) n from c) where n = 1""",
)
def c19(s, d):
    u = motifs(s, d).groupBy("region", "motif").agg(F.min("idx").alias("id"))
    short = u.select((F.col("id") * 2).alias("id"), "region", F.col("motif").substr((F.col("id") % 5 + 1).cast("int"), F.lit(16)).alias("seq"), F.lit(True).alias("placeholder"), F.lit("N").alias("name"))
    whole = u.select((F.col("id") * 2 + 1).alias("id"), "region", F.col("motif").alias("seq"), F.lit(False).alias("placeholder"), F.concat(F.lit("N"), (F.col("id") % 11).cast("string")).alias("name"))
    return G.contained_in(short.unionByName(whole).withColumn("ord", F.col("id")), "region")


# ---- aggregations -----------------------------------------------------------------------------------


@query("d01_attr_first", BASE + "select ord, gene_id, gene_name, gene_biotype, tag from fr")
def d01(s, d):
    return gtf_rows(s, d).select("ord", "gene_id", "gene_name", "gene_biotype", "tag")


@query(
    "d03_split_codon",
    BASE + """, c as (select seqname chrom, gene_id, transcript_id, feature, strand, case when strand = '-' then "end" - 1 else start - 1 end b from fr where feature in ('start_codon', 'stop_codon'))
    select chrom, gene_id, transcript_id, feature, strand, case when (feature = 'start_codon') = (strand <> '-') then min(b) else max(b) end base from c group by 1, 2, 3, 4, 5""",
)
def d03(s, d):
    return E.split_codons(gtf_rows(s, d).select(F.col("seqname").alias("chrom"), "gene_id", "transcript_id", "feature", (F.col("start") - 1).alias("start"), "end", "strand"))


@query("d04_tx_length", BASE + "select distinct gene_id, transcript_id, transcript_length from ex")
def d04(s, d):
    return exons(s, d).select("gene_id", "transcript_id", "transcript_length").distinct()


@query("d05_best_tx", BASE + "select * from best")
def d05(s, d):
    return E.best_transcripts(exons(s, d))


@query("d07_region_counts", BASE + "select feature_type, cast(count(*) as double) count from mr group by 1")
def d07(s, d):
    return M.region_counts(mapped(s, d))


def split_row(s, d, strategy):
    a, b, c = M.gene_splits(mapped(s, d), strategy)
    return s.createDataFrame([(round(a, 6), round(b, 6), round(c, 6))], "utr5 double, cds double, utr3 double")


SPLITS = BASE + ", t as (select distinct transcript_id, transcript_length l, start_codon_pos a, stop_codon_pos b from ma where transcript_length is not null and start_codon_pos is not null and stop_codon_pos is not null), m as (select {f}(a) x, {f}(b + 3 - a) y, {f}(l - b - 3) z from t) select round(x / (x + y + z), 6) utr5, round(y / (x + y + z), 6) cds, round(z / (x + y + z), 6) utr3 from m"
query("d08_splits_mean", SPLITS.format(f="avg"))(lambda s, d: split_row(s, d, "mean"))
query("d08_splits_median", SPLITS.format(f="median"))(lambda s, d: split_row(s, d, "median"))


def positions(s, d):
    p = M.middle(F.col("transcript_start"), F.col("transcript_end"))
    return with_region(mapped(s, d)).where("feature_type <> 'None'").withColumn("x", M.feature_position(p, (0.2, 0.5, 0.3), F.col("transcript_length"), F.col("start_codon_pos"), F.col("stop_codon_pos"))).withColumn("w", F.col("site_id") % 7)


BINS = ", b as (select i bin, i / 20.0 a, (i + 1) / 20.0 z from range(20) t(i)), h as (select least(cast(floor(round(x * 20, 9)) as int), 19) bin, count(*) n, sum(w) w from hist where x between 0 and 1 group by 1) "


def rounded(df: DataFrame, x: str) -> DataFrame:
    """Positions rounded to the ninth place, so that both engines put a value on a border into the same bin."""
    return df.withColumn(x, F.round(F.col(x) * 20, 9) / 20)


@query("d09_hist_uniform", BASE + BINS + "select cast(b.bin as int) bin, cast(coalesce(n, 0) as double) count from b left join h on h.bin = b.bin")
def d09(s, d):
    return M.histogram(rounded(positions(s, d), "x"), "x", [round(i / 20, 10) for i in range(21)]).select("bin", "count")


@query("d09_hist_weighted", BASE + BINS + "select cast(b.bin as int) bin, cast(coalesce(w, 0) as double) count_w, round(coalesce(w / n, 0), 6) mean_w from b left join h on h.bin = b.bin")
def d09w(s, d):
    return M.histogram(rounded(positions(s, d), "x"), "x", [round(i / 20, 10) for i in range(21)], ["w"]).select("bin", "count_w", F.round("mean_w", 6).alias("mean_w"))


@query("d10_bin_stats", BASE + BINS + "select cast(b.bin as int) bin, coalesce(n, 0) count, cast(coalesce(w, 0) as double) sum, round(coalesce(w / n, 0), 6) mean from b left join h on h.bin = b.bin")
def d10(s, d):
    return M.bin_statistics(rounded(positions(s, d), "x"), "x", "w", 20).select("bin", "count", F.col("sum").cast("double").alias("sum"), F.round("mean", 6).alias("mean"))


@query("d12_ref_points", BASE + "select transcript_id, 0 tss, max(transcript_length) tes, min(start_codon_pos) start_codon, min(stop_codon_pos) stop_codon, max(start_offset) last_junction from ex group by 1")
def d12(s, d):
    e = exons(s, d)
    out = E.reference_points(e, "tss").withColumnRenamed("ref_pos", "tss")
    for p in ("tes", "start_codon", "stop_codon", "last_junction"):
        out = out.join(E.reference_points(e, p).withColumnRenamed("ref_pos", p), "transcript_id")
    return out.withColumn("tss", F.col("tss").cast("int"))


@query("d13_unambiguous", BASE + "select * from un")
def d13(s, d):
    b, p = cover(s, d)
    return Q.unambiguous(p, b)


@query("d14_gene_counts", BASE + 'select gene_id, count(*) "reads", cast(sum(case when "read" % 5 <> 0 then 1 else 0 end) as bigint) unique_reads from un where "read" % 4 <> 0 group by 1')
def d14(s, d):
    b, p = cover(s, d)
    flags = b.select("read").distinct().withColumn("hq", F.col("read") % 4 != 0).withColumn("duplicate", F.col("read") % 5 == 0)
    return Q.gene_counts(Q.unambiguous(p, b), flags)


@query("d15_exon_doses", BASE + ', z as (select "read", sum(b_end - b_start) t from bl group by 1), q as (select distinct "read" from un), v as (select distinct "read", block_no, b_start, b_end, transcript_id, e_start, gene_id, "full" from fx) select transcript_id || \':\' || cast(e_start as varchar) exon_id, round(sum((b_end - b_start) / t), 6) dose from fx join q on q."read" = fx."read" join z on z."read" = fx."read" where "full" group by 1')
def d15(s, d):
    b, p = cover(s, d)
    return Q.exon_doses(p, Q.unambiguous(p, b), b).select("exon_id", F.round("dose", 6).alias("dose"))


def has(bit: int) -> str:
    return f"(f // {bit}) % 2 = 1"


USED, PAIRS = f"not ({has(256)} or {has(512)} or {has(2048)}) and not {has(4)}", f"{has(1)} and not {has(8)}"
COUNTED = {
    "total": "true", "secondary": has(256), "supplementary": has(2048), "failed": f"not {has(2048)} and {has(512)}", "low_mapq": f"not {has(2048)} and not {has(512)} and q < 255", "passed": f"not ({has(256)} or {has(512)} or {has(2048)})",
    "unpaired": f"not ({has(256)} or {has(512)} or {has(2048)}) and not {has(1)}", "mapped": USED, "duplicates": f"{USED} and {has(1024)}", "unique": f"{USED} and not {has(1024)}", "end1": f"{USED} and {PAIRS} and {has(64)}", "end2": f"{USED} and {PAIRS} and not {has(64)}",
    "duplicate_pairs": f"{USED} and {PAIRS} and {has(64)} and {has(1024)}", "unique_fragments": f"{USED} and {PAIRS} and {has(64)} and not {has(1024)}", "high_quality": f"{USED} and nm <= 6 and {has(2)} and q >= 255", "low_quality": f"{USED} and not (nm <= 6 and {has(2)} and q >= 255)",
}
SUMMED = {
    "bases": (USED, "b"), "mismatches": (USED, "nm"), "blocks": (USED, "k"), "end1_mismatches": (f"{USED} and {PAIRS} and {has(64)}", "nm"), "end1_bases": (f"{USED} and {PAIRS} and {has(64)}", "b"), "end2_mismatches": (f"{USED} and {PAIRS} and not {has(64)}", "nm"),
    "end2_bases": (f"{USED} and {PAIRS} and not {has(64)}", "b"),
}


@query(
    "d17_flag_counters",
    "select " + ", ".join([*(f'count(case when {c} then 1 end) "{n}"' for n, c in COUNTED.items()), *(f"cast(coalesce(sum(case when {c} then {v} end), 0) as bigint) {n}" for n, (c, v) in SUMMED.items())])
    + f", cast(max(case when {USED} then b else 0 end) as bigint) read_length from (select annotation_id * 37 % 4096 f, case when annotation_id % 11 = 0 then 10 else 255 end q, annotation_id % 9 nm, case when annotation_id % 3 = 0 then 50 else annotation_id % 40 + 20 end b, case when annotation_id % 3 = 0 then 2 else 1 end k from annotation)",
)
def d17(s, d):
    n = F.col("annotation_id")
    cigar = F.when(n % 3 == 0, "2S20M9N3I30=").otherwise(F.concat((n % 40 + 20).cast("string"), F.lit("M")))
    return Q.counters(table(s, d, "annotation").select((n * 37 % 4096).cast("int").alias("flag"), F.when(n % 11 == 0, 10).otherwise(255).alias("mapq"), (n % 9).cast("int").alias("nm"), F.coalesce("pos", F.lit(1)).alias("pos"), cigar.alias("cigar")))


@query("d18_classes", BASE + """, g as (select gene_id, chrom, min(e_start) a, max(e_end) b from ex group by 1, 2), bo as (select distinct "read" from bl join g on bl.chrom = g.chrom and b_start < b and a < b_end), tou as (select distinct "read" from fx), uu as (select distinct "read" from un)
    select case when u."read" is not null then 'exonic' when t."read" is not null then 'ambiguous' when o."read" is not null then 'intronic' else 'intergenic' end "class", count(*) "reads" from bt left join uu u on u."read" = bt."read" left join tou t on t."read" = bt."read" left join bo o on o."read" = bt."read" group by 1""")
def d18(s, d):
    b, p = cover(s, d)
    genes = exons(s, d).groupBy("gene_id", "chrom").agg(F.min("e_start").alias("g_start"), F.max("e_end").alias("g_end"))
    return Q.classes(b, p, Q.unambiguous(p, b), genes).groupBy("class").agg(F.count("*").alias("reads"))


@query("d19_non_globin", BASE + """, n as (select gene_id, min(gene_name) nm from ex group by 1), r as (select "read", max(case when nm in ('HBA1', 'HBA2', 'HBB', 'HBBP1', 'HBD', 'HBE1', 'HBG1', 'HBG2', 'HBM', 'HBQ1', 'HBZ', 'HBZP1') then 1 else 0 end) g from un join n on n.gene_id = un.gene_id group by 1)
    select count(*) "reads", cast(sum(case when "read" % 5 = 0 then 1 else 0 end) as bigint) duplicates from r where g = 0""")
def d19(s, d):
    b, p = cover(s, d)
    names = exons(s, d).groupBy("gene_id").agg(F.min("gene_name").alias("gene_name"))
    return Q.non_globin(Q.unambiguous(p, b), names, b.select("read").distinct().withColumn("duplicate", F.col("read") % 5 == 0))


@query("d21_tpm", BASE + ', c as (select gene_id, count(*) n from un group by 1), l as (select gene_id, sum(e_end - e_start) l from ex group by 1), x as (select c.gene_id, n, n * 1000.0 / l v from c join l on l.gene_id = c.gene_id) select gene_id, n "reads", round(v / (select sum(v) from x) * 1e6, 4) tpm from x')
def d21(s, d):
    b, p = cover(s, d)
    n = Q.unambiguous(p, b).groupBy("gene_id").agg(F.count("*").alias("reads"))
    size = exons(s, d).groupBy("gene_id").agg(F.sum(F.col("e_end") - F.col("e_start")).alias("gene_length"))
    return Q.tpm(n.join(size, "gene_id")).select("gene_id", "reads", F.round("tpm", 4).alias("tpm"))


@query("d23_stats", BASE + ", t as (select distinct gene_id, transcript_id, cast(transcript_length as double) x from ex), m as (select median(x) m from t) select round(avg(x), 4) mean, median(x) median, round(stddev_pop(x), 4) std, round(median(abs(x - m)) * 1.4826, 4) mad, quantile_cont(x, 0.25) p25, quantile_cont(x, 0.75) p75 from t, m")
def d23(s, d):
    t = exons(s, d).select("gene_id", "transcript_id", F.col("transcript_length").cast("double").alias("x")).distinct()
    r = Q.stats(t, "x")
    return r.select(*[F.round(c, 4).alias(c) if c in ("mean", "std", "mad") else c for c in r.columns])


@query(
    "d24_coverage_bias",
    BASE + """, g as (select transcript_id gene_id, max(transcript_length) l from ex group by 1 having max(transcript_length) >= 600), c as (select transcript_id gene_id, transcript_start a, least(transcript_start + 120, transcript_length) b from (select distinct site_id, transcript_id, transcript_start, transcript_length from ma where transcript_id is not null) where transcript_start < transcript_length),
    w as (select gene_id, k, case when k = 5 then 150 + i else l - 250 + i end p from g, (values (3), (5)) v(k), range(100) r(i)), n as (select w.gene_id, k, p, count(a) n from w left join c on c.gene_id = w.gene_id and a <= p and p < b group by 1, 2, 3), m as (select gene_id, k, median(n) m from n group by 1, 2),
    z as (select gene_id, max(case when k = 3 then m end) c3, max(case when k = 5 then m end) c5 from m group by 1) select gene_id, round(c3 / (c3 + c5), 6) bias from z where c3 + c5 > 0""",
)
def d24(s, d):
    e = exons(s, d)
    genes = e.groupBy(F.col("transcript_id").alias("gene_id")).agg(F.max("transcript_length").alias("exon_length"))
    m = mapped(s, d).where("transcript_id is not null").select("site_id", "transcript_id", "transcript_start", "transcript_length").distinct().where("transcript_start < transcript_length")
    c = m.select(F.col("transcript_id").alias("gene_id"), F.col("transcript_start").alias("c_start"), F.least(F.col("transcript_start") + 120, F.col("transcript_length")).alias("c_end"))
    return Q.three_prime_bias(c, genes).select("gene_id", F.round("bias", 6).alias("bias"))


@query(
    "d25_fragments",
    BASE + """, rd as (select annotation_id q, 0 e, chrom, p s, annotation_id % 60 + 20 z from bl0 union all select annotation_id, 1, chrom, p + annotation_id % 60, annotation_id % 60 + 20 from bl0),
    hd as (select q, e, z, min(transcript_id || ':' || cast(e_start as varchar)) x from rd join ex on rd.chrom = ex.chrom and e_start <= s and s + 20 <= e_end group by 1, 2, 3 having count(distinct transcript_id || ':' || cast(e_start as varchar)) = 1)
    select z size, count(*) n from (select q, x, min(z) z from hd group by 1, 2 having count(*) = 2) group by 1""",
)
def d25(s, d):
    """Pairs made from annotation rows: 20 bases, and 20 of the mate up to 59 further on."""
    a = table(s, d, "annotation").where("pos is not null and chrom is not null").groupBy("annotation_id").agg(F.min("chrom").alias("rname"), (F.min("pos") - 1).alias("p"))
    size = F.col("annotation_id") % 60 + 20
    r = a.select("annotation_id", "rname", "p", size.alias("size"), F.explode(F.array(F.lit(0), F.lit(1))).alias("e")).select((F.col("annotation_id") * 2 + F.col("e")).alias("read"), F.col("annotation_id").cast("string").alias("qname"), "rname", F.when(F.col("e") == 0, F.col("p")).otherwise(F.col("p") + F.col("size") - 20).alias("pos"), F.when(F.col("e") == 0, 99).otherwise(147).alias("flag"), F.lit("20M").alias("cigar"), F.when(F.col("e") == 0, F.col("size")).otherwise(-F.col("size")).alias("tlen"), F.lit(True).alias("paired"), F.lit(True).alias("hq"))
    b = Q.read_blocks(r)
    e = exons(s, d).withColumn("exon_id", F.concat_ws(":", "transcript_id", "e_start"))
    return Q.fragments(Q.full_cover(b, e), b, r).groupBy("size").agg(F.count("*").alias("n"))


@query("d27_logo_counts", "with " + MOTIFS + ", p as (select i position, substr(replace(motif, 'T', 'U'), cast(i + 1 as bigint), 1) base, w, idx from mo, range(21) r(i)) select cast(position as int) position, base, sum(w) score, cast(row_number() over (partition by position order by sum(w) desc, min(idx)) as int) \"rank\" from p group by 1, 2, position")
def d27(s, d):
    return O.motif_scores(motifs(s, d))


@query("h38_logo_bits", "with " + MOTIFS + ", n as (select count(*) n from mo), p as (select i position, substr(replace(motif, 'T', 'U'), cast(i + 1 as bigint), 1) base, sum(w) c from mo, range(21) r(i) group by 1, 2), q as (select position, (2 + sum(case when c > 0 then c / n * log2(c / n) else 0 end)) / max(n) info from p, n group by 1) select cast(p.position as int) position, base, round(c * info, 6) score from p join q on q.position = p.position")
def h38(s, d):
    return O.motif_scores(motifs(s, d), bits=True).select("position", "base", F.round("score", 6).alias("score"))


@query("d28_consensus", "with " + MOTIFS + ", p as (select region, i, substr(motif, cast(i + 1 as bigint), 1) ch, count(*) n from mo, range(21) r(i) where region is not null group by 1, 2, 3), b as (select *, row_number() over (partition by region, i order by n desc, ch) k from p) select region, string_agg(ch, '' order by i) consensus from b where k = 1 group by 1")
def d28(s, d):
    return G.column_consensus(motifs(s, d).where("region is not null"), "region", "motif")


@query(
    "d30_export_table",
    BASE + """, c as (select *, case when start_codon_pos >= start_offset and start_codon_pos < end_offset then case when strand = '-' then e_end - (start_codon_pos - start_offset) else e_start + start_codon_pos - start_offset + 1 end end a, case when stop_codon_pos >= start_offset and stop_codon_pos < end_offset then case when strand = '-' then e_end - (stop_codon_pos - start_offset) else e_start + stop_codon_pos - start_offset + 1 end end b from ex)
    select gene_id, transcript_id, min(chrom) chrom, min(strand) strand, string_agg(cast(e_start + 1 as varchar) || '-' || cast(e_end as varchar), ',' order by start_offset) spans, max(a) start_codon, max(b) stop_codon, min(e_start) + 1 transcript_start, max(e_end) transcript_end from c group by 1, 2""",
)
def d30(s, d):
    return E.export_table(exons(s, d))


@query(
    "b04_export_gtf",
    BASE + "select 'gene' feature, count(*) n, cast(sum(s) as bigint) total from (select gene_id, min(e_start) + 1 s from ex group by 1) union all select 'transcript', count(*), cast(sum(s) as bigint) from (select gene_id, transcript_id, min(e_start) + 1 s from ex group by 1, 2) union all select 'exon', count(*), cast(sum(e_start + 1) as bigint) from ex",
)
def b04(s, d):
    return E.export_gtf(exons(s, d)).where("feature in ('gene', 'transcript', 'exon')").groupBy("feature").agg(F.count("*").alias("n"), F.sum("start").alias("total"))


MERGED = BASE + """, q as (select gene_id, transcript_id, seqname, strand, start - 1 s, "end" e from pr where feature = 'exon' and gene_id is not null), m as (select *, max(e) over (partition by gene_id, transcript_id, seqname, strand order by s, e rows between unbounded preceding and 1 preceding) b from (select distinct * from q)),
i as (select *, sum(case when s > b then 1 else 0 end) over (partition by gene_id, transcript_id, seqname, strand order by s, e rows unbounded preceding) n from m), mg as (select gene_id, transcript_id, seqname, strand, min(s) + 1 start, max(e) "end" from i group by gene_id, transcript_id, seqname, strand, n) """


@query("d34_interval_merge", MERGED + "select * from mg")
def d34(s, d):
    return N.merged_rows(pruned(s, d), "exon")


@query("e08_exon_number", MERGED + "select *, cast(row_number() over (partition by gene_id, transcript_id order by case when strand = '-' then -start else start end, seqname, strand) as int) exon_number from mg where (gene_id, transcript_id) in (select (gene_id, transcript_id) from mg group by gene_id, transcript_id having count(distinct seqname) = 1 and count(distinct strand) = 1)")
def e08(s, d):
    e = N.merged_rows(pruned(s, d), "exon")
    w = Window.partitionBy("gene_id", "transcript_id")
    one = (F.min("seqname").over(w) == F.max("seqname").over(w)) & (F.min("strand").over(w) == F.max("strand").over(w))
    return N.exon_numbers(e.withColumn("_o", one).where("_o").drop("_o"))


@query("d35_canonical", BASE + """, t as (select gene_id, transcript_id, max(case when feature = 'CDS' then 1 else 0 end) c, coalesce(sum(case when feature = 'exon' then "end" - start + 1 end), 0) l, min(ord) o from pr where transcript_id is not null group by 1, 2)
    select gene_id, transcript_id from (select *, row_number() over (partition by gene_id order by c desc, l desc, o) n from t) where n = 1""")
def d35(s, d):
    return N.canonical_transcripts(pruned(s, d))


@query("d36_feature_sets", BASE + ", g as (select gene_id, string_agg(feature, ',' order by feature) features from (select distinct gene_id, feature from pr) group by 1) select features, count(*) count, round(count(*) / (select count(*) from g), 6) ratio from g group by 1")
def d36(s, d):
    return N.feature_combinations(pruned(s, d))


@query("d33_inferred_kind", BASE + """, g as (select gene_id, count(distinct gene_biotype) nb, min(gene_biotype) b, count(distinct gene_name) nn, min(gene_name) n, max(case when feature = 'CDS' then 1 else 0 end) c from pr group by 1) select gene_id, case when nb = 1 then b when c = 1 then 'protein_coding' else 'unknown' end gene_biotype, case when nn = 1 then n else gene_id end gene_name from g""")
def d33(s, d):
    return N.inferred_kind(pruned(s, d))


@query("d41_inconsistent", BASE + """, a as (select gene_id from pr group by 1 having count(distinct seqname) > 1 or count(distinct strand) > 1 or sum(case when feature = 'gene' then 1 else 0 end) > 1),
    b as (select gene_id from pr where transcript_id is not null group by gene_id, transcript_id having sum(case when feature = 'transcript' then 1 else 0 end) > 1 or min(start) < min(case when feature = 'transcript' then start end) or max("end") > max(case when feature = 'transcript' then "end" end)) select gene_id from a union select gene_id from b""")
def d41(s, d):
    return N.inconsistent_genes(pruned(s, d))


@query("d32_gene_features", BASE + """select gene_id, first(seqname order by ord) chrom, first(strand order by ord) strand, first(gene_name order by ord) gene_name, coalesce(min(case when feature = 'gene' then start end), min(case when feature = 'exon' then start end)) g_start, coalesce(max(case when feature = 'gene' then "end" end), max(case when feature = 'exon' then "end" end)) g_end,
    cast(coalesce(sum(case when feature = 'exon' then "end" - start end), 0) as bigint) gene_length, bool_or(coalesce(lower(gene_biotype) like '%rrna%' or lower(gene_biotype) like '%ribosomal%', false) or coalesce(lower(gene_name) like '%rrna%' or lower(gene_name) like '%ribosomal%', false)) ribosomal from pr group by 1""")
def d32(s, d):
    return Q.gene_features(pruned(s, d).withColumnRenamed("seqname", "chrom")).select("gene_id", "chrom", "strand", "gene_name", "g_start", "g_end", "gene_length", "ribosomal")


@query("h45_derived_codons", BASE + """, c as (select gene_id, transcript_id, seqname, strand, min(start) a, max("end") b from pr where feature = 'CDS' group by 1, 2, 3, 4) select gene_id, transcript_id, seqname, strand, 'start_codon' feature, case when strand = '-' then b - 2 else a end start, case when strand = '-' then b else a + 2 end "end" from c
    union all select gene_id, transcript_id, seqname, strand, 'stop_codon', case when strand = '-' then a - 3 else b + 1 end, case when strand = '-' then a - 1 else b + 3 end from c""")
def h45(s, d):
    return N.derived_codons(pruned(s, d).where("feature = 'CDS'"))


@query("h47_bounding_rows", BASE + """, h as (select distinct gene_id from pr where feature = 'gene') select gene_id, min(start) + case when bool_and(feature = 'CDS') and arg_min(strand, ord) = '-' then -3 else 0 end start, max("end") + case when bool_and(feature = 'CDS') and arg_min(strand, ord) <> '-' then 3 else 0 end "end" from pr where gene_id not in (select gene_id from h) group by 1""")
def h47(s, d):
    return N.bounding_rows(pruned(s, d), "gene").select("gene_id", "start", "end")


def merged_sql(name: str, feature: str) -> str:
    return f"""{name} as (select gene_id, transcript_id, seqname, strand, min(s) + 1 start, max(e) "end" from (select *, sum(case when s > b then 1 else 0 end) over (partition by gene_id, transcript_id, seqname, strand order by s, e rows unbounded preceding) n from
    (select *, max(e) over (partition by gene_id, transcript_id, seqname, strand order by s, e rows between unbounded preceding and 1 preceding) b from (select distinct gene_id, transcript_id, seqname, strand, start - 1 s, "end" e from gd where feature = '{feature}'))) group by gene_id, transcript_id, seqname, strand, n)"""


def bounding_sql(by: str) -> str:
    kind = "transcript" if "transcript" in by else "gene"
    tx = "transcript_id" if kind == "transcript" else "null::varchar"
    return f"""select gene_id, {tx} transcript_id, first(seqname order by ord) seqname, first(strand order by ord) strand, min(start) - case when bool_and(feature = 'CDS') and first(strand order by ord) = '-' then 3 else 0 end start, max("end") + case when bool_and(feature = 'CDS') and first(strand order by ord) <> '-' then 3 else 0 end "end", '{kind}' feature, null::int exon_number
    from gd where {'transcript_id is not null and' if kind == 'transcript' else ''} ({by}) not in (select ({by}) from gd where feature = '{kind}') group by {by}"""


@query(
    "j10_refine",
    BASE + """, ic as (select gene_id from pr group by 1 having count(distinct seqname) > 1 or count(distinct strand) > 1 or sum(case when feature = 'gene' then 1 else 0 end) > 1
      union select gene_id from pr where transcript_id is not null group by gene_id, transcript_id having sum(case when feature = 'transcript' then 1 else 0 end) > 1 or min(start) < min(case when feature = 'transcript' then start end) or max("end") > max(case when feature = 'transcript' then "end" end)),
    gd as (select * from pr where gene_id not in (select gene_id from ic)), """ + merged_sql("me", "exon") + ", " + merged_sql("mc", "CDS") + """,
    en as (select *, cast(row_number() over (partition by gene_id, transcript_id order by case when strand = '-' then -start else start end) as int) n from (select * from me union all select * from mc where (gene_id, transcript_id) not in (select (gene_id, transcript_id) from me))),
    cn as (select c.*, (select max(n) from en where en.gene_id = c.gene_id and en.transcript_id = c.transcript_id and en.start <= c.start and c."end" <= en."end") n, (select max(start) from en where en.gene_id = c.gene_id and en.transcript_id = c.transcript_id and en.start <= c.start and c."end" <= en."end") a, (select max("end") from en where en.gene_id = c.gene_id and en.transcript_id = c.transcript_id and en.start <= c.start and c."end" <= en."end") z from mc c),
    ck as (select gene_id, n is not null and coalesce(abs(n - lag(n) over w) = 1, true) and (lag(start) over w is null or start = a) and (lead(start) over w is null or "end" = z) ok from cn window w as (partition by gene_id, transcript_id order by start)),
    wr as (select gene_id from ck where not coalesce(ok, false)),
    hc as (select * from gd where feature in ('start_codon', 'stop_codon')),
    c2 as (select gene_id, transcript_id, seqname, strand, min(start) a, max("end") b from mc group by 1, 2, 3, 4),
    dc as (select gene_id, transcript_id, seqname, strand, case when strand = '-' then b - 2 else a end start, case when strand = '-' then b else a + 2 end "end", 'start_codon' feature from c2 union all select gene_id, transcript_id, seqname, strand, case when strand = '-' then a - 3 else b + 1 end, case when strand = '-' then a - 1 else b + 3 end, 'stop_codon' from c2),
    al as (select gene_id, transcript_id, seqname, strand, start, "end", feature, null::int exon_number from gd where feature in ('gene', 'transcript') union all """ + bounding_sql("gene_id") + " union all " + bounding_sql("gene_id, transcript_id") + """
      union all select gene_id, transcript_id, seqname, strand, start, "end", 'exon', n from en union all select gene_id, transcript_id, seqname, strand, start, "end", 'CDS', n from cn union all select gene_id, transcript_id, seqname, strand, start, "end", feature, null from hc
      union all select gene_id, transcript_id, seqname, strand, start, "end", feature, null from dc where (gene_id, transcript_id, feature) not in (select (gene_id, transcript_id, feature) from hc)),
    nm0 as (select gene_id, count(distinct gene_biotype) nb, min(gene_biotype) b, count(distinct gene_name) nn, min(gene_name) n, max(case when feature = 'CDS' then 1 else 0 end) c, min(ord) ord from gd group by 1),
    nm1 as (select gene_id, ord, case when nb = 1 then b when c = 1 then 'protein_coding' else 'unknown' end gene_biotype, case when nn = 1 then n else gene_id end gene_name from nm0),
    nm as (select gene_id, gene_biotype, case when row_number() over (partition by gene_name order by ord) > 1 then gene_name || '_' || gene_id else gene_name end gene_name from nm1),
    ct as (select gene_id, transcript_id from (select *, row_number() over (partition by gene_id order by c desc, l desc, o) k from (select gene_id, transcript_id, max(case when feature = 'CDS' then 1 else 0 end) c, coalesce(sum(case when feature = 'exon' then "end" - start + 1 end), 0) l, min(ord) o from gd where transcript_id is not null group by 1, 2)) where k = 1)
    select al.gene_id, al.transcript_id, seqname, strand, start, "end", feature, exon_number, gene_biotype, gene_name, case when ct.transcript_id is not null then 'Ensembl_canonical' end tag from al join nm on nm.gene_id = al.gene_id left join ct on ct.gene_id = al.gene_id and ct.transcript_id = al.transcript_id where al.gene_id not in (select gene_id from wr)""",
)
def j10(s, d):
    return N.refine(gtf_rows(s, d))[0].select("gene_id", "transcript_id", "seqname", "strand", "start", "end", "feature", "exon_number", "gene_biotype", "gene_name", "tag")


@query(
    "j09_prepare",
    BASE + r""", bad as (select gene_id, transcript_id from fr where transcript_id is not null group by 1, 2 having count(distinct nullif(seqname, '')) > 1 or count(distinct nullif(strand, '')) > 1 or count(distinct nullif(gene_name, '')) > 1),
    u as (select * from fr where transcript_id is not null and gene_id is not null and (gene_id, transcript_id) not in (select (gene_id, transcript_id) from bad where gene_id is not null)),
    sp as (select gene_id, transcript_id, string_agg(x, ',' order by k, x) spans from (select distinct gene_id, transcript_id, case when strand = '-' then -start else start end k, cast(start as varchar) || '-' || cast("end" as varchar) x from u where feature = 'exon' and start is not null and "end" is not null) group by 1, 2),
    t as (select gene_id, transcript_id, first(seqname order by ord) chrom, first(strand order by ord) strand, first(gene_name order by ord) gene_name, last(tag order by ord) tag, min(ord) ord, coalesce(sum(case when feature = 'exon' then "end" - start + 1 end), 0) len, min(case when feature = 'start_codon' then start end) start_codon, min(case when feature = 'stop_codon' then start end) stop_codon,
      min(case when feature = 'exon' then start end) transcript_start, max(case when feature = 'exon' then "end" end) transcript_end from u group by 1, 2),
    r as (select t.*, spans, case when tag in ('MANE_Select', 'Ensembl_canonical', 'basic') then 0 when regexp_extract(t.transcript_id, '\.(\d+)$', 1) <> '' then 2 when regexp_extract(t.transcript_id, '-(\d+)$', 1) <> '' then 3 else 4 end a,
      case tag when 'MANE_Select' then 0 when 'Ensembl_canonical' then 1 when 'basic' then 2 else coalesce(try_cast(nullif(regexp_extract(t.transcript_id, '[.-](\d+)$', 1), '') as bigint), case when len >= 100000 then 100001 else 100100 - len end) end b from t join sp on sp.gene_id = t.gene_id and sp.transcript_id = t.transcript_id)
    select gene_id, transcript_id, chrom, strand, spans, start_codon, stop_codon, gene_name, transcript_start, transcript_end from (select *, row_number() over (partition by gene_id order by a, b, ord) n from r) where n = 1""",
)
def j09(s, d):
    return N.prepare(gtf_rows(s, d))


@query(
    "j01_exon_reference",
    BASE + """, p as (select seqname chrom, feature, start - 1 s, "end" e, strand, v[list_position(k, 'gene_id')] gene_id, v[list_position(k, 'transcript_id')] transcript_id, v[list_position(k, 'tag')] tag, v[list_position(k, 'transcript_support_level')] tsl from fa where feature in ('exon', 'start_codon', 'stop_codon')),
    x as (select *, cast(case when tag = 'Ensembl_canonical' then 0 when upper(split_part(tsl, ' ', 1)) in ('NA', 'NAN') then 6 else coalesce(try_cast(split_part(tsl, ' ', 1) as bigint), 10) end as bigint) lv, cast(sum(e - s) over w as bigint) end_offset, cast(sum(e - s) over (partition by gene_id, transcript_id) as bigint) len
      from p where feature = 'exon' window w as (partition by gene_id, transcript_id order by case when strand = '-' then -s else s end nulls first, e nulls first, chrom nulls first, strand nulls first rows unbounded preceding)),
    y as (select *, end_offset - (e - s) start_offset from x),
    c as (select chrom, gene_id, transcript_id, feature, strand, case when (feature = 'start_codon') = (strand <> '-') then min(case when strand = '-' then e - 1 else s end) else max(case when strand = '-' then e - 1 else s end) end b from p where feature <> 'exon' group by 1, 2, 3, 4, 5),
    o as (select c.transcript_id, min(case when feature = 'start_codon' then q end) a, min(case when feature = 'stop_codon' then q end) z from (select c.*, case when y.strand = '-' then y.e - b - 1 else b - y.s end + start_offset q from c join y on y.chrom = c.chrom and y.transcript_id = c.transcript_id and y.s <= b and b < y.e) c group by 1)
    select gene_id, y.transcript_id, chrom, s e_start, e e_end, start_offset, end_offset, len transcript_length, lv transcript_level, a start_codon_pos, z stop_codon_pos from y left join o on o.transcript_id = y.transcript_id""",
)
def j01(s, d):
    f = table(s, d, "feature")
    return E.exon_reference(f).select("gene_id", "transcript_id", "chrom", "e_start", "e_end", "start_offset", "end_offset", "transcript_length", F.col("transcript_level").cast("long").alias("transcript_level"), "start_codon_pos", "stop_codon_pos")


@query("d42_table_ranks", BASE + "select gene_id, count(distinct transcript_id) transcripts, count(*) exons, min(e_start) lo, max(e_end) hi from ex group by 1")
def d42(s, d):
    return exons(s, d).groupBy("gene_id").agg(F.count_distinct("transcript_id").alias("transcripts"), F.count("*").alias("exons"), F.min("e_start").alias("lo"), F.max("e_end").alias("hi"))


# ---- windows ----------------------------------------------------------------------------------------


@query("e01_exon_offsets", BASE + "select gene_id, transcript_id, e_start, e_end, start_offset, end_offset from ex")
def e01(s, d):
    return exons(s, d).select("gene_id", "transcript_id", "e_start", "e_end", "start_offset", "end_offset")


@query("e06_rolling_mean", BASE + BINS + ", c as (select b.bin, coalesce(n, 0) n from b left join h on h.bin = b.bin) select cast(bin as int) bin, round(case when count(*) over w = 3 then avg(n) over w end, 6) count from c window w as (order by bin rows between 1 preceding and 1 following)")
def e06(s, d):
    h = M.histogram(rounded(positions(s, d), "x"), "x", [round(i / 20, 10) for i in range(21)])
    return M.rolling_mean(h, "count", 3).select("bin", F.round("count", 6).alias("count"))


@query("e11_dup_names", BASE + ", g as (select gene_id, min(gene_name) nm from ex where gene_name is not null group by 1) select gene_id, case when row_number() over (partition by nm order by gene_id) > 1 then nm || '_' || gene_id else nm end gene_name from g")
def e11(s, d):
    g = exons(s, d).where("gene_name is not null").groupBy("gene_id").agg(F.min("gene_name").alias("gene_name"))
    return N.unique_names(g, "gene_name", "gene_id", F.col("gene_id"))


# ---- scalar functions -------------------------------------------------------------------------------

ANN = "select annotation_id, transcript_motif m, codon_ref c, aa_ref a from annotation"


def ann(s, d):
    return table(s, d, "annotation").select("annotation_id", F.col("transcript_motif").alias("m"), F.col("codon_ref").alias("c"), F.col("aa_ref").alias("a"))


@query("h01_revcomp", f"select annotation_id, reverse(translate(m, 'ACGTacgt', 'TGCAtgca')) r from ({ANN})")
def h01(s, d):
    return ann(s, d).select("annotation_id", S.reverse_complement(F.col("m")).alias("r"))


@query("h02_reverse_base", f"select annotation_id, reverse(case when regexp_full_match(m, '[ACGTUMRWSYKVHDBN.-]*') then translate(m, 'ACGTUMRWSYKVHDBN.-', 'TGCAAKYWSRMBDHVN.-') else m end) r from ({ANN})")
def h02(s, d):
    return ann(s, d).select("annotation_id", S.reverse_base(F.col("m")).alias("r"))


@query("h04_base_convert", "select doc_id, case when text like '>%' then text else translate(text, 'TtCc', 'UuUu') end r from documents")
def h04(s, d):
    return table(s, d, "documents").select("doc_id", S.convert_bases(F.col("text"), "TC", "UU").alias("r"))


@query("h07_flip_flag", "select annotation_id, cast(case when f % 2 = 1 then xor(f, 48) else xor(f, 16) end as int) r from (select annotation_id, cast(annotation_id % 4096 as int) f from annotation)")
def h07(s, d):
    return table(s, d, "annotation").select("annotation_id", R.flip_flag((F.col("annotation_id") % 4096).cast("int")).alias("r"))


@query("h08_cigar_blocks", BASE + 'select "read", block_no, b_start, b_end from bl')
def h08(s, d):
    return blocks(s, d).select("read", "block_no", "b_start", "b_end")


HITS = BASE + """, hit as (select site_id, pos, tx.gene_id, tx.transcript_id, tx.strand ts, lo, hi, tx.start_codon_pos sc, tx.stop_codon_pos st, ex.start_offset so, case when tx.strand = '-' then e_end - pos else pos - 1 - e_start end + start_offset t
  from si join tx on si.chrom = tx.chrom and lo < pos and pos <= hi left join ex on ex.gene_id = tx.gene_id and ex.transcript_id = tx.transcript_id and ex.chrom = tx.chrom and ex.strand = tx.strand and e_start < pos and pos <= e_end),
h1 as (select *, row_number() over (partition by site_id, gene_id, transcript_id, ts order by so) n from hit),
reg as (select site_id, gene_id, transcript_id, t transcript_pos, lo, hi, pos, ts, case when t is null then 'Intronic' when sc is null then 'NoncodingTranscript' when t < sc then 'FivePrimeUTR' when t >= st + 3 then 'ThreePrimeUTR' else 'CDS' end region, sc from h1 where n = 1) """


@query("h13_region", HITS + "select site_id, gene_id, transcript_id, region, transcript_pos from reg union all select site_id, null, null, 'Intergenic', null from si where site_id not in (select site_id from reg)")
def h13(s, d):
    return A.annotate(sites(s, d).withColumn("ref", F.lit("N")).withColumn("alt", F.lit("N")), exons(s, d), every=True).select("site_id", "gene_id", "transcript_id", "region", "transcript_pos")


@query(
    "h15_splice_distance",
    HITS + """, o as (select gene_id, transcript_id, chrom, strand, e_start, e_end, row_number() over (partition by gene_id, transcript_id, chrom, strand order by start_offset, end_offset, e_start, e_end) i, count(*) over (partition by gene_id, transcript_id, chrom, strand) k from ex),
    c as (select r.site_id, r.gene_id, r.transcript_id, r.ts, i, 0 j, case when ts = '-' then e_end - (pos - 1) else pos - 1 - e_start end x from reg r join o on o.gene_id = r.gene_id and o.transcript_id = r.transcript_id and o.strand = r.ts and o.chrom = (select chrom from si where si.site_id = r.site_id) where i > 1
      union all select r.site_id, r.gene_id, r.transcript_id, r.ts, i, 1, case when ts = '-' then e_start - (pos - 1) else pos - 1 - e_end end from reg r join o on o.gene_id = r.gene_id and o.transcript_id = r.transcript_id and o.strand = r.ts and o.chrom = (select chrom from si where si.site_id = r.site_id) where i < k),
    z as (select *, row_number() over (partition by site_id, gene_id, transcript_id, ts order by abs(x), i, j) n from c)
    select r.site_id, r.gene_id, r.transcript_id, x distance2splice from reg r left join z on z.site_id = r.site_id and z.gene_id = r.gene_id and z.transcript_id = r.transcript_id and z.ts = r.ts and n = 1""",
)
def h15(s, d):
    return A.annotate(sites(s, d).withColumn("ref", F.lit("N")).withColumn("alt", F.lit("N")), exons(s, d), every=True).where("gene_id is not null").select("site_id", "gene_id", "transcript_id", "distance2splice")


def amino_sql(codon: str) -> str:
    """The amino acid sign of a codon of T, C, A and G in SQL."""
    at = [f"(strpos('TCAG', substr({codon}, {i}, 1)) - 1) * {n}" for i, n in ((1, 16), (2, 4), (3, 1))]
    return f"substr('{S.CODE}', cast({' + '.join(at)} + 1 as bigint), 1)"


#: Spliced sequences: letters from a hash of the transcript's id, as long as the transcript.
SPLICED = "substr(repeat(translate(md5(transcript_id), '0123456789abcdef', 'ACGTTGCACATGGTAC'), cast({n} // 32 + 1 as {t})), 1, cast({n} as {t}))"
CODED = f"""case when regexp_full_match({{c}}, '[TCAG][TCAG][TCAG]') then case when {amino_sql('{c}')} = '*' then 'STOP' else {amino_sql('{c}')} end else 'X' end"""


@query(
    "j06_annotate_top",
    HITS + f""", sq as (select gene_id, transcript_id, {SPLICED.format(n="max(transcript_length)", t="bigint")} q from ex group by 1, 2),
    hs as (select reg.*, sq.q, case when st is null then length(q) - reg.sc else st + 3 - reg.sc end cl, substr('ACGT', cast(reg.site_id % 4 + 1 as bigint), 1) rf, substr('ACGT', cast(reg.site_id // 4 % 4 + 1 as bigint), 1) al from reg join sq on sq.gene_id = reg.gene_id and sq.transcript_id = reg.transcript_id join (select distinct gene_id g, transcript_id t, ts s2, st from hit) u on u.g = reg.gene_id and u.t = reg.transcript_id and u.s2 = reg.ts),
    cd as (select *, case when region = 'CDS' then substr(q, cast(sc + 1 as bigint), cast(cl as bigint)) end cds, case when region = 'CDS' then transcript_pos - sc end cp from hs),
    co as (select *, substr(cds, cast(cp // 3 * 3 + 1 as bigint), 3) codon, substr(substr(cds, cast(cp // 3 * 3 + 1 as bigint), 3), 1, cast(cp % 3 as bigint)) || al || substr(substr(cds, cast(cp // 3 * 3 + 1 as bigint), 3), cast(cp % 3 + 2 as bigint)) changed from cd),
    ty as (select *, case when region <> 'CDS' or codon = '' then region when length(codon) < 3 then 'CDS' when {amino_sql("codon")} = {amino_sql("changed")} then 'Silent' when {amino_sql("changed")} = '*' then 'PrematureStop' else 'Substitution' end kind from co),
    k as (select *, list_position(['Intergenic', 'Intronic', 'NoncodingTranscript', 'IncompleteTranscript', 'FivePrimeUTR', 'ThreePrimeUTR', 'IntronicSpliceSite', 'Silent', 'CDS', 'Substitution', 'ComplexSubstitution', 'InFrameIndel', 'FrameShift', 'PrematureStop', 'SpliceSite'], kind) w from ty),
    b as (select *, row_number() over (partition by site_id order by w desc, lo, hi, gene_id, transcript_id) n from k)
    select si.site_id, gene_id, transcript_id, transcript_pos, coalesce(region, 'Intergenic') region, case when transcript_pos is not null then transcript_pos + coalesce(sc, 0) end gene_pos, ts transcript_strand, kind mut_type, case when transcript_pos is not null then substr(repeat('N', 10) || q || repeat('N', 10), cast(transcript_pos + 1 as bigint), 21) end transcript_motif,
      cp coding_pos, codon codon_ref, cp // 3 + 1 aa_pos, case when cds is not null then substr(array_to_string(list_transform(range(0, length(cds) // 3), lambda i: {CODED.format(c="substr(cds, cast(i * 3 + 1 as bigint), 3)")}), ''), cast(cp // 3 + 1 as bigint), 1) end aa_ref from si left join b on b.site_id = si.site_id and n = 1""",
)
def j06(s, d):
    """Real alleles on transcripts with sequences: every column but the splice distance (h15)."""
    e = exons(s, d)
    letters = lambda k: F.lit("ACGT").substr((k % 4 + 1).cast("int"), F.lit(1))
    v = sites(s, d).withColumn("ref", letters(F.col("site_id"))).withColumn("alt", letters(F.floor(F.col("site_id") / 4)))
    seqs = e.groupBy("gene_id", "transcript_id").agg(F.max("transcript_length").alias("n")).select("gene_id", "transcript_id", F.expr(SPLICED.format(n="n", t="int").replace("//", "div").replace("md5(transcript_id)", "md5(cast(transcript_id as binary))")).alias("spliced"))
    return A.annotate(v, e, seqs).select("site_id", *[c for c in A.COLUMNS if c != "distance2splice"])


CODON_SQL = f"""select annotation_id, case when regexp_full_match(u, '[TCAG][TCAG][TCAG]') then case when {{a}} = '*' then 'STOP' else {{a}} end end aa from (select annotation_id, translate(upper(c), 'U', 'T') u from ({ANN}))"""


@query("h17_translate", CODON_SQL.format(a=amino_sql("u")))
def h17(s, d):
    return ann(s, d).select("annotation_id", S.translate_codon(F.col("c")).alias("aa"))


SNV = f"""with q as (select annotation_id, c, annotation_id % 3 o, substr('ACGT', cast(annotation_id % 4 + 1 as bigint), 1) alt from ({ANN}) where regexp_full_match(c, '[ACGT][ACGT][ACGT]')),
r as (select annotation_id, c, substr(c, 1, cast(o as bigint)) || alt || substr(c, cast(o + 2 as bigint)) n from q), t as (select annotation_id, {amino_sql("c")} x, {amino_sql("n")} y from r)
select annotation_id, case when x = y then 'Silent' when y = '*' then 'PrematureStop' else 'Substitution' end effect from t"""


@query("h19_snv_effect", SNV)
def h19(s, d):
    q = ann(s, d).where(F.col("c").rlike("^[ACGT]{3}$"))
    alt = F.lit("ACGT").substr((F.col("annotation_id") % 4 + 1).cast("int"), F.lit(1))
    return q.select("annotation_id", A.effect(F.col("c"), F.lit("A"), alt, (F.col("annotation_id") % 3).cast("int")).alias("effect"))


@query("h23_feature_pos", BASE + "select site_id, round(x, 9) x from (select mr.site_id, case when feature_type = '5UTR' then transcript_start / greatest(start_codon_pos, 1) * 0.2 when feature_type = 'CDS' then 0.2 + (transcript_start - start_codon_pos) / greatest(stop_codon_pos + 3 - start_codon_pos, 1) * 0.5 when feature_type = '3UTR' then 0.2 + 0.5 + (transcript_start - stop_codon_pos - 3) / greatest(transcript_length - stop_codon_pos - 3, 1) * 0.3 end x from mr where feature_type <> 'None')")
def h23(s, d):
    return positions(s, d).select("site_id", F.round("x", 9).alias("x"))


SEQS = "sq as (select doc_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') q from documents where text is not null), ss as (select * from sq where q <> '') "


def contigs(s, d):
    q = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    return table(s, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("chrom"), F.col("doc_id"), q.alias("seq")).where("seq <> ''")


@query("h29_motif_window", "with " + SEQS + ", w as (select doc_id, q, doc_id * 31 % (length(q) + 8) + 1 p, doc_id % 2 = 0 m from ss), v as (select doc_id, m, substr(repeat('N', 30) || q || repeat('N', 60), cast(p + 23 as bigint), 12) z from w) select doc_id, case when m then reverse(translate(z, 'ACGT', 'TGCA')) else z end motif from v")
def h29(s, d):
    c = contigs(s, d)
    at = c.select("doc_id", "chrom", F.length("seq").cast("long").alias("length"), (F.col("doc_id") * 31 % (F.length("seq") + 8) + 1).alias("pos"), F.when(F.col("doc_id") % 2 == 0, "-").otherwise("+").alias("strand"))
    chunks = tables.chunked(c.select("chrom", F.lit(0).cast("long").alias("at"), "seq"), 256)
    return O.site_motifs(at.drop("length"), chunks, at.select("chrom", "length"), "doc_id", 7, 4, 256).select("doc_id", "motif")


@query("a16_fetch", "with " + SEQS + "select doc_id, substr(q, cast(least(doc_id % 300, length(q)) + 1 as bigint), 400) s from ss")
def a16(s, d):
    c = contigs(s, d)
    chunks = tables.chunked(c.select("chrom", F.lit(0).cast("long").alias("at"), "seq"), 256)
    at = c.select("doc_id", "chrom", F.least(F.col("doc_id") % 300, F.length("seq").cast("long")).alias("a")).withColumn("b", F.col("a") + 400)
    return tables.fetch(chunks, at, "doc_id", "a", "b", 256).select("doc_id", F.col("seq").alias("s"))


@query("h26_weights", BASE + "select site_id, case when w = 0 then null else round(log2(w / transcript_length), 6) end w from (select site_id, transcript_length, site_id % 7 w from ma where transcript_length is not null)")
def h26(s, d):
    m = mapped(s, d).where("transcript_length is not null").withColumn("w", (F.col("site_id") % 7).cast("string"))
    v = M.weights(m, "w", True, "log2")
    return v.select("site_id", F.when(F.col("w") != float("-inf"), F.round("w", 6)).alias("w"))


@query("h34_sanitize", r"with q as (select doc_id, author a from documents), r as (select doc_id, a, regexp_replace(substr(a, 1, 1), '[^0-9A-Za-z!#$%&+./:;?@^_|~-]', '_', 'g') || regexp_replace(substr(a, 2), '[^0-9A-Za-z!#$%&*+./:;=?@^_|~-]', '_', 'g') c from q) select doc_id, case when a is null or a = '' or a = c then a else c || '_' || substr(md5(a), 1, 8) end name from r")
def h34(s, d):
    return table(s, d, "documents").select("doc_id", N.sanitized(F.col("author")).alias("name"))


def snrna_sql(n: str) -> str:
    out = n
    for pattern, new in G.SNRNA:
        out = f"regexp_replace({out}, '{pattern}', '{new.replace('$', chr(92))}', 'g')"
    return f"case when starts_with({n}, 'snRNA:') then split_part({n}, ':', 2) else {out} end"


@query(
    "h35_rename",
    f"""with g as (select distinct gene_id, gene_biotype b0, gene_name n from gene where gene_id is not null and gene_biotype is not null and gene_name is not null),
    k as (select *, case when b0 <> 'misc_RNA' then b0 when starts_with(n, 'VTRNA') and contains(n, 'P') then 'Vault_RNA_pseudogene' when starts_with(n, 'RN7SL') and ends_with(n, 'P') then 'scRNA' when starts_with(n, 'RN7SKP') then 'snRNA' when starts_with(n, 'RNY') and contains(n, 'P') then 'Y_RNA_pseudogene'
      when starts_with(n, 'RN7SL') or n in ('Metazoa_SRP', '7SL') then 'scRNA' when starts_with(n, 'RNY') or n = 'Y_RNA' then 'Y_RNA' when n in ('RN7SK', '7SK') then 'snRNA' when n = 'Vault' then 'vault_RNA' when starts_with(n, 'SCARNA') then 'scaRNA' else b0 end b, {snrna_sql("n")} f from g),
    t as (select *, case when contains(f, '_tRNA-') then 'tRNA-' || regexp_extract(f, '_tRNA-(.*)$', 1) when b = 'tRNA' and not starts_with(f, 'tRNA') then 'tRNA-' || case when f = '' then 'unknown' else f end else f end r, upper(f) u from k)
    select gene_id, n gene_name, b biotype, case b when 'snRNA' then case when starts_with(u, '7SK') then '7SK' when starts_with(u, 'SNAR-') then regexp_replace(f, '[0-9-]+$', '') when starts_with(u, 'U') then f else 'Ux' end when 'Y_RNA' then case when u = 'Y_RNA' then 'RNYx' else f end
      when 'snoRNA' then case when starts_with(u, 'SNOR') then split_part(f, '-', 1) when starts_with(u, 'U8') then 'SNORD118' when starts_with(u, 'U') then case when regexp_matches(u, '^U[0-9]') then 'SNORD' || regexp_extract(u, '^U([0-9]+)', 1) || coalesce(nullif(regexp_extract(u, '^U[0-9]+([A-Z]?)', 1), ''), 'A') else f end when starts_with(u, 'RNU') then f else 'SNORx' end
      when 'miRNA' then case when split_part(f, '-', 1) = 'Mir3535' then 'SNORx' when starts_with(u, 'MIR') then split_part(f, '-', 1) when contains(u, 'LET') or contains(u, 'MIR') then f else 'MIRx' end else case when starts_with(r, 'tRNA-') then regexp_replace(r, '[0-9-]+$', '') else r end end family from t""",
)
def h35(s, d):
    g = table(s, d, "gene").select("gene_id", "gene_biotype", "gene_name").dropna().distinct()
    b = G.misc_biotype(F.col("gene_biotype"), F.col("gene_name"))
    return g.select("gene_id", "gene_name", b.alias("biotype"), G.family(b, F.col("gene_name")).alias("family"))


@query(
    "h51_positions",
    f"""with a as (select line_no, string_split(line, chr(9)) f from site_lines), b as (select line_no, translate(trim(f[2], e' \\t\\r\\n\\f\\x0b\u00a0\u3000'), '{L.DIGITS}', '{"0123456789" * (len(L.DIGITS) // 10)}') p from a where len(f) > 1), c as (select line_no, regexp_replace(regexp_replace(p, '([0-9])_([0-9])', '\\1\\2', 'g'), '([0-9])_([0-9])', '\\1\\2', 'g') p from b)
    select line_no, coalesce(case when regexp_full_match(p, '{L.NUMBER[1:-1]}') and abs(try_cast(p as double)) < 9223372036854775808.0 then try_cast(trunc(try_cast(p as double)) as bigint) end, -1) pos from c""",
)
def h51(s, d):
    """The second field of every line that has one, whatever stands in it."""
    f = F.split("line", "\t", -1)
    return table(s, d, "site_lines").withColumn("f", f).where(F.size("f") > 1).select("line_no", L.position(F.get("f", F.lit(1))).alias("pos"))


# ---- operators that SQL can't tell ------------------------------------------------------------------


@query("h06_reverse_md", f"select annotation_id, cast(annotation_id % 7 as varchar) || '^' || reverse(translate(substr(m, 5, 2), 'ACGTacgt', 'TGCAtgca')) || '5' || translate(substr(m, 3, 1), 'ACGTacgt', 'TGCAtgca') || cast(annotation_id % 40 as varchar) md from ({ANN}) where length(m) = 21")
def h06(s, d):
    md = F.concat((F.col("annotation_id") % 40).cast("string"), F.substring("m", 3, 1), F.lit("5^"), F.substring("m", 5, 2), (F.col("annotation_id") % 7).cast("string"))
    return ann(s, d).where("length(m) = 21").select("annotation_id", R.reverse_md(md).alias("md"))


PAIRED = "list_filter(range(1, 21), lambda i: {c})"
WANT, GOT = "substr(r, cast(i as bigint), 1)", "substr(m, cast(i + case when i > 10 then 1 else 0 end as bigint), 1)"


def pairs_sql(condition: str) -> str:
    return f"len({PAIRED.format(c=condition.format(w=WANT, g=GOT))})"


@query(
    "h05_score_reads",
    f"""with a as (select annotation_id, m, translate(substr(m, 1, 20), 'C', 'T') r, annotation_id % 2 = 0 plus from ({ANN}) where length(m) = 21),
    b as (select *, {PAIRED.format(c=f"{WANT} <> {GOT}")} l, {pairs_sql("{w} = {g}")} same, case when plus then {pairs_sql("{w} = 'A' and {g} = 'G'")} else {pairs_sql("{w} = 'G' and {g} = 'A'")} end yf, case when plus then {pairs_sql("{w} = 'C' and {g} = 'T'")} else {pairs_sql("{w} = 'T' and {g} = 'C'")} end yc,
      case when plus then {pairs_sql("{w} = {g} and {g} = 'A'")} else {pairs_sql("{w} = {g} and {g} = 'T'")} end zf, case when plus then {pairs_sql("{w} = {g} and {g} = 'C'")} else {pairs_sql("{w} = {g} and {g} = 'G'")} end zc from a)
    select annotation_id, cast(same + yf + yc - (len(l) - yf - yc) - 1 as int) score, cast(len(l) - yf - yc as int) mismatches, array_to_string(list_transform(range(1, len(l) + 1), lambda k: cast(l[k] - coalesce(case when k > 1 then l[k - 1] end, 0) - 1 as varchar) || substr(r, cast(l[k] as bigint), 1)), '') || cast(20 - coalesce(l[-1], 0) as varchar) md,
      cast(yf as int) yf, cast(zf as int) zf, cast(yc as int) yc, cast(zc as int) zc, cast(len(l) - yf - yc as int) ns, cast(1 as int) nc from b""",
)
def h05(s, d):
    return ann(s, d).where("length(m) = 21").select("annotation_id", R.score_reads(F.lit("10M1I10M"), F.col("m"), F.translate(F.col("m").substr(1, 20), "C", "T"), F.col("annotation_id") % 2 == 0).alias("r")).select("annotation_id", "r.*")


@query("d29_clusters")
def d29(s, d):
    m = motifs(s, d).select(F.concat_ws("/", F.coalesce("region", F.lit("?")), F.substring("motif", 1, 4)).alias("family"), F.col("idx").cast("string").alias("gene_id"), F.col("motif").alias("seq"))
    return G.cluster_families(m, 0.3).select("family", "gene_id", "cluster_id", "consensus")


def read_table(s, d):
    sound = A.transcripts(one_row(exons(s, d), "transcript_id")).withColumn("ord", F.col("transcript_id"))
    a = table(s, d, "annotation").select(F.col("annotation_id").alias("ord"), norm("transcript_id").alias("rname"), F.col("transcript_pos").alias("pos")).where("rname is not null and pos is not null")
    r = motifs(s, d).select(F.col("idx").alias("ord"), "motif").join(a.groupBy("ord").agg(F.min(F.struct("rname", "pos")).alias("a")).select("ord", "a.*"), "ord")
    return sound, r.select(F.concat(F.lit("r"), F.col("ord").cast("string")).alias("qname"), F.lit(0).alias("flag"), "rname", "pos", F.lit(60).alias("mapq"), F.lit("21M").alias("cigar"), F.lit("*").alias("rnext"), F.lit(-1).cast("long").alias("pnext"), F.lit(0).cast("long").alias("tlen"), F.col("motif").alias("seq"), F.lit("I" * 21).alias("qual"), F.create_map(F.lit("NM"), F.lit("i:0")).alias("tags"), "ord")


LIFTED = BASE + ", " + MOTIFS.strip() + """, fs as (select transcript_id, min(row(gene_id, chrom, strand)) k from ex group by 1), e1 as (select ex.transcript_id, ex.chrom, ex.strand, e_start, e_end from ex join fs on fs.transcript_id = ex.transcript_id and row(gene_id, chrom, strand) = k),
    e2 as (select *, sum(e_end - e_start) over (partition by transcript_id order by e_start, e_end rows unbounded preceding) - (e_end - e_start) bf, sum(e_end - e_start) over (partition by transcript_id) len from e1),
    an as (select annotation_id, min({'n': upper(trim(transcript_id)), 'p': transcript_pos}) r from annotation where transcript_id is not null and transcript_pos is not null group by 1), rd as (select idx, r.n n, r.p p from mo join an on annotation_id = idx),
    tl as (select rd.*, strand, chrom, len, case when strand = '-' then len - p - 21 else p end tp, coalesce(p >= 0 and p + 21 <= len, false) ok from rd left join (select distinct transcript_id, chrom, strand, len from e2) t on t.transcript_id = n),
    pc as (select idx, bf, e_start + greatest(tp - bf, 0) g, least(tp + 21, bf + e_end - e_start) - greatest(tp, bf) m, e_start - lag(e_end) over (partition by idx order by bf) gap from tl join e2 on e2.transcript_id = n and bf < tp + 21 and tp < bf + e_end - e_start where ok),
    pi as (select *, sum(case when gap > 0 then 1 else 0 end) over (partition by idx order by bf rows unbounded preceding) i from pc), pm as (select idx, i, sum(m) m, first(gap order by bf) gap, first(g order by bf) g from pi group by 1, 2),
    cg as (select idx, string_agg(case when i > 0 then cast(gap as bigint) || 'N' else '' end || cast(m as bigint) || 'M', '' order by i) c, first(g order by i) g from pm group by 1) """


@query("i1_to_genome", LIFTED + "select 'r' || tl.idx qname, cast(case when ok and strand = '-' then 16 else 0 end as int) flag, case when ok then chrom else n end rname, cast(case when ok then g else p end as bigint) pos, case when ok then c else '21M' end cigar, not ok demoted from tl left join cg on cg.idx = tl.idx")
def i1(s, d):
    tx, r = read_table(s, d)
    return L.lift_reads(r, tx).select("qname", "flag", "rname", "pos", "cigar", "demoted")


@query("i2_to_transcript", LIFTED + "select 'r' || idx qname, cast(0 as int) flag, n rname, p pos, '21M' cigar from tl where ok")
def i2(s, d):
    tx, r = read_table(s, d)
    back = L.lift_reads(r, tx).where("not demoted").drop("demoted")
    lifted = back.join(r.select("ord", F.col("rname").alias("transcript_id")), "ord")
    return L.lift_reads(lifted, tx, "transcript").select("qname", "flag", "rname", "pos", "cigar")


@query("d26_complexity")
def d26(s, d):
    n = table(s, d, "annotation").agg(F.count_distinct("annotation_id").alias("u"), F.count("*").alias("n")).first()
    return s.createDataFrame([(Q.library_complexity(n["u"], n["n"] - n["u"]),)], "molecules bigint")


@query(
    "j02_metagene",
    BASE + """, t as (select distinct transcript_id, transcript_length l, start_codon_pos a, stop_codon_pos b from ma where transcript_id is not null and transcript_length is not null and start_codon_pos is not null and stop_codon_pos is not null), m as (select median(a) x, median(b + 3 - a) y, median(l - b - 3) z from t), s as (select x / (x + y + z) s0, y / (x + y + z) s1, z / (x + y + z) s2 from m),
    g as (select 0.0::double a, s0 z from s union all select s0, least(1.0, s0 + s1) from s union all select least(1.0, s0 + s1), 1.0 from s), n as (select a, z, greatest(1, round_even((z - a) * 60, 0)) n from g where z > a), e as (select a + (z - a) * i / n e from n, range(200) r(i) where i < n union all select 1.0),
    b as (select cast(row_number() over (order by e) - 1 as int) bin, e, lead(e) over (order by e) f from (select distinct e from e)),
    x as (select case when feature_type = '5UTR' then transcript_start / greatest(start_codon_pos, 1) * s0 when feature_type = 'CDS' then s0 + (transcript_start - start_codon_pos) / greatest(stop_codon_pos + 3 - start_codon_pos, 1) * s1 else s0 + s1 + (transcript_start - stop_codon_pos - 3) / greatest(transcript_length - stop_codon_pos - 3, 1) * s2 end x from mr, s where feature_type <> 'None')
    select bin, round((e + f) / 2, 6) feature_midpoint, cast((select count(*) from x where x >= e and (x < f or x = 1 and f = 1)) as double) count, case when (e + f) / 2 < s0 then '5UTR' when (e + f) / 2 > s0 + s1 then '3UTR' else 'CDS' end feature_type from b, s where f is not null""",
)
def j02(s, d):
    p = M.metagene(spans(s, d).withColumnRenamed("site_id", "record_id"), exons(s, d), 60)
    return p.select("bin", F.round("feature_midpoint", 6).alias("feature_midpoint"), "count", "feature_type")


@query(
    "j03_metagene_point",
    BASE + """, r as (select transcript_id, min(start_codon_pos) p from bx group by 1), h as (select least((transcript_start - p + 200) // 20, 49) b, count(*) n from ma join r on r.transcript_id = ma.transcript_id where p is not null and transcript_start - p between -200 and 800 group by 1)
    select cast(t.b as int) bin, 20.0::double * t.b - 190 distance_bp, cast(coalesce(n, 0) as double) count from range(50) t(b) left join h on h.b = t.b""",
)
def j03(s, d):
    p, _ = M.metagene_point(spans(s, d).withColumnRenamed("site_id", "record_id"), exons(s, d), "start_codon", 200, 800, 50)
    return p.select("bin", F.round("distance_bp", 6).alias("distance_bp"), "count")


# ---- more functions, filters and sinks --------------------------------------------------------------


EXPANDED = "case upper(b) " + " ".join(f"when '{k}' then '{','.join(v)}'" for k, v in S.EXPANSIONS.items()) + " end"


@query("h03_expand_base", f"select annotation_id, string_agg(coalesce({EXPANDED}, '?'), ';' order by i) e from (select annotation_id, i, substr(m, cast(i as bigint), 1) b from (select distinct annotation_id, m from ({ANN})), range(1, 200) t(i) where i <= length(m)) group by 1")
def h03(s, d):
    """Every base of every motif."""
    each = F.transform(F.split("m", ""), lambda b: F.coalesce(F.array_join(S.expand_base(b), ","), F.lit("?")))
    return ann(s, d).where("m <> ''").select("annotation_id", F.array_join(each, ";").alias("e")).distinct()


@query("h16_padded_motif", "with " + SEQS + "select doc_id, substr(repeat('N', 10) || q || repeat('N', 20), cast(doc_id % length(q) + 1 as bigint), 21) m from ss")
def h16(s, d):
    return contigs(s, d).select("doc_id", S.padded_motif(F.col("seq"), F.col("doc_id") % F.length("seq"), 10).alias("m"))


@query("h17_protein", "with " + SEQS + f"select doc_id, array_to_string(list_transform(range(0, length(q) // 3), lambda i: {CODED.format(c='substr(q, cast(i * 3 + 1 as bigint), 3)')}), '') protein from ss where length(q) >= 3")
def h17p(s, d):
    return contigs(s, d).where("length(seq) >= 3").select("doc_id", S.protein_text(F.col("seq")).alias("protein"))


@query("h30_mark_site", f"select annotation_id, substr(m, 1, k) || '[' || substr(m, k + 1, 1) || ']' || substr(m, k + 2) r from (select *, case when annotation_id % 2 = 0 then 13 else 7 end k from ({ANN})) where length(m) = 21")
def h30(s, d):
    strand = F.when(F.col("annotation_id") % 2 == 0, "-").otherwise("+")
    return ann(s, d).where("length(m) = 21").select("annotation_id", S.mark_site(F.col("m"), strand, 7, 13).alias("r"))


@query("h31_builtin_names", "select name, case when regexp_full_match(name, '[1-9][0-9]?|X|Y') then 'chr' || name when name = 'MT' then 'chrM' else name end renamed from contig")
def h31(s, d):
    return O.rename_chromosomes(table(s, d, "contig").select("name", F.col("name").alias("renamed")), "renamed", tables.builtin_names(s, "E2U"))


@query("h32_transcript_level", "select annotation_id, cast(case when t = 'Ensembl_canonical' then 0 when upper(split_part(l, ' ', 1)) in ('NA', 'NAN') then 6 else coalesce(try_cast(split_part(l, ' ', 1) as bigint), 10) end as bigint) lv from (select annotation_id, case when annotation_id % 7 = 0 then 'Ensembl_canonical' when annotation_id % 7 < 3 then 'basic' end t, case annotation_id % 5 when 0 then 'NA' when 1 then '1 (assigned to previous version 2)' when 2 then '5' when 3 then 'x' end l from annotation)")
def h32(s, d):
    n = F.col("annotation_id")
    tag = F.when(n % 7 == 0, "Ensembl_canonical").when(n % 7 < 3, "basic")
    sup = F.when(n % 5 == 0, "NA").when(n % 5 == 1, "1 (assigned to previous version 2)").when(n % 5 == 2, "5").when(n % 5 == 3, "x")
    return table(s, d, "annotation").select("annotation_id", E.transcript_level(tag, sup).cast("long").alias("lv"))


@query("h33_rank", "select gene_id, transcript_id, cast(case when m = 0 then 0 when m = 1 then 0 when m = 2 then 1 else 4 end as bigint) a, cast(case when m = 0 then 1 when m = 1 then 2 when m = 2 then l % 5 + 1 else case when l >= 100000 then 100001 else 100100 - l end end as bigint) b from (select gene_id, transcript_id, max(transcript_length) l, max(transcript_length) % 4 m from ex group by 1, 2)".join([BASE, ""]))
def h33(s, d):
    t = exons(s, d).groupBy("gene_id", "transcript_id").agg(F.max("transcript_length").alias("l")).withColumn("m", F.col("l") % 4)
    tag = F.when(F.col("m") == 0, "x; Ensembl_canonical").when(F.col("m") == 1, "basic")
    sup = F.when(F.col("m") == 2, (F.col("l") % 5 + 1).cast("string"))
    return t.withColumn("r", N.rank_transcript(tag, sup, F.col("transcript_id"), F.col("l"))).select("gene_id", "transcript_id", "r.a", "r.b")


@query("h43_rates", BASE + ", c as (select chrom, count(*) n, sum(case when strand = '+' then 1 else 0 end) p from si group by 1) select chrom, round(p / n, 6) rate from c")
def h43(s, d):
    c = sites(s, d).groupBy("chrom").agg(F.count("*").alias("n"), F.count_if(F.col("strand") == "+").alias("p"))
    return c.select("chrom", F.round(Q.rate(F.col("p"), F.col("n")), 6).alias("rate"))


@query("h50_spliced_spans", BASE + "select gene_id, transcript_id, string_agg(cast(start_offset + 1 as varchar) || '-' || cast(end_offset as varchar), ',' order by start_offset) spans from ex group by 1, 2")
def h50(s, d):
    return E.spliced_spans(exons(s, d))


@query("h52_canonical_tag", BASE + "select ord, case when tag is null or tag = '' then 'Ensembl_canonical' when tag = 'Ensembl_canonical' then tag else tag || '; Ensembl_canonical' end tag from fr")
def h52(s, d):
    return gtf_rows(s, d).select("ord", N.with_canonical_tag(F.col("tag")).alias("tag"))


@query("h55_to_rna", f"select annotation_id, replace(m, 'T', 'U') r from ({ANN})")
def h55(s, d):
    return ann(s, d).select("annotation_id", S.to_rna(F.col("m")).alias("r"))


@query("d11_region_ratios", BASE + ", f as (select transcript_id, feature, sum(\"end\" - start + 1) n from fr where feature in ('exon', 'CDS', 'start_codon') and transcript_id is not null and start <= \"end\" group by 1, 2), m as (select feature, median(n) m from f group by 1) select feature \"type\", round(m / (select sum(m) from m), 6) ratio from m")
def d11(s, d):
    f = gtf_rows(s, d).where("feature in ('exon', 'CDS', 'start_codon') and transcript_id is not null and start <= end").select(F.col("transcript_id").alias("transcript"), F.col("feature").alias("type"), (F.col("end") - F.col("start") + 1).alias("len_of_window"))
    return M.region_ratios(f).select("type", F.round("ratio", 6).alias("ratio"))


@query("d20_sense", BASE + ", g as (select gene_id, chrom, strand, min(e_start) a, max(e_end) b from ex group by 1, 2, 3), r as (select \"read\", max(case when strand = '+' then 1 else 0 end) p, max(case when strand = '-' then 1 else 0 end) m from bl join g on bl.chrom = g.chrom and b_start < b and a < b_end group by 1) select count(case when p = 1 and m = 0 then 1 end) sense, count(case when p = 0 and m = 1 then 1 end) antisense, count(case when p = 1 and m = 1 then 1 end) both_strands from r")
def d20(s, d):
    g = exons(s, d).groupBy("gene_id", "chrom", "strand").agg(F.min("e_start").alias("g_start"), F.max("e_end").alias("g_end")).withColumn("ribosomal", F.lit(False))
    met = Q.marks(s.createDataFrame([], "read bigint, strand string, ribosomal boolean"), Q.body_pairs(blocks(s, d), g, ("strand", "ribosomal")))
    return met.agg(F.count_if(F.expr("plus and not minus")).alias("sense"), F.count_if(F.expr("minus and not plus")).alias("antisense"), F.count_if(F.expr("plus and minus")).alias("both_strands"))


@query("d22_genes_detected", BASE + ", c as (select gene_id from un where \"read\" % 5 <> 0 group by 1 having count(*) >= 5) select count(*) genes from c")
def d22(s, d):
    b, p = cover(s, d)
    u = Q.unambiguous(p, b).withColumn("duplicate", F.col("read") % 5 == 0)
    return u.groupBy("gene_id").agg(F.count_if(~F.col("duplicate")).alias("n")).where("n >= 5").agg(F.count("*").alias("genes"))


@query("d37_summary", BASE + ", p as (select feature_type, transcript_start x from mr where feature_type <> 'None') select feature_type, count(*) n, round(avg(x), 4) mean, median(x) median, cast(min(x) as bigint) least, cast(max(x) as bigint) greatest from p group by 1")
def d37(s, d):
    p = with_region(mapped(s, d)).where("feature_type <> 'None'").withColumn("feature_pos", F.col("transcript_start"))
    return M.summary(p).withColumn("mean", F.round("mean", 4))


@query("d38_conflicts", BASE + "select gene_id, transcript_id from pr where transcript_id is not null group by 1, 2 having count(distinct nullif(seqname, '')) > 1 or count(distinct nullif(strand, '')) > 1 or count(distinct nullif(gene_name, '')) > 1")
def d38(s, d):
    return N.conflicting_transcripts(pruned(s, d).where("transcript_id is not null"), ["seqname", "strand", "gene_name"])


@query("d31_bounding_boxes", BASE + "select gene_id, transcript_id, chrom, strand, lo, hi from tx")
def d31(s, d):
    return A.transcripts(exons(s, d)).select("gene_id", "transcript_id", "chrom", "strand", "lo", "hi")


@query("c14_point_distance", BASE + ", r as (select transcript_id, min(start_codon_pos) p from bx group by 1) select site_id, gene_id, ma.transcript_id, transcript_start - p distance from ma join r on r.transcript_id = ma.transcript_id where p is not null and transcript_start - p between -200 and 800")
def c14(s, d):
    e = exons(s, d)
    best = e.join(E.best_transcripts(e).select("transcript_id").distinct(), "transcript_id", "left_semi")
    return M.with_distance(mapped(s, d), best, "start_codon").where("distance between -200 and 800").select("site_id", "gene_id", "transcript_id", "distance")


@query("c21_rejected_rows", BASE + """, a as (select gene_id from pr group by 1 having count(distinct seqname) > 1 or count(distinct strand) > 1 or sum(case when feature = 'gene' then 1 else 0 end) > 1),
    b as (select gene_id from pr where transcript_id is not null group by gene_id, transcript_id having sum(case when feature = 'transcript' then 1 else 0 end) > 1 or min(start) < min(case when feature = 'transcript' then start end) or max("end") > max(case when feature = 'transcript' then "end" end)) select ord from pr where gene_id in (select gene_id from a union select gene_id from b)""")
def c21(s, d):
    p = pruned(s, d)
    return N.without_genes(p, N.inconsistent_genes(p))[1].select("ord")


@query("b14_score_matrix", "with " + MOTIFS + ", p as (select i position, substr(replace(motif, 'T', 'U'), cast(i + 1 as bigint), 1) base, w from mo, range(21) r(i)) select cast(position as int) position, coalesce(sum(case when base = 'A' then w end), 0) \"A\", coalesce(sum(case when base = 'C' then w end), 0) \"C\", coalesce(sum(case when base = 'G' then w end), 0) \"G\", 0.0::double \"T\", coalesce(sum(case when base = 'U' then w end), 0) \"U\" from p group by 1")
def b14(s, d):
    return O.score_matrix(O.motif_scores(motifs(s, d))).select("position", "A", "C", "G", "T", "U")


@query("b08_text_table", "select annotation_id, coalesce(region, '') region, coalesce(cast(gene_pos as varchar), '') gene_pos, coalesce(codon_ref, '') codon_ref from annotation".replace("select annotation_id", "select cast(annotation_id as varchar) annotation_id"))
def b08(s, d):
    return A.for_text(table(s, d, "annotation").select("annotation_id", "region", "gene_pos", "codon_ref"))


@query("b09_effect_names", "select cast(annotation_id as varchar) annotation_id, coalesce(mut_type, 'None') mut_type from annotation")
def b09(s, d):
    return A.for_text(table(s, d, "annotation").select("annotation_id", "mut_type"), "None")


@query("a19_alias_names", "select upper(trim(alias)) k, name from chrom_alias")
def a19(s, d):
    return table(s, d, "chrom_alias").select(norm("alias").alias("k"), "name")


@query("a11_annotation_exons", BASE + ", sp as (select gene_id, transcript_id, min(chrom) chrom, min(strand) strand from ex group by 1, 2) select e.gene_id, e.transcript_id, sp.chrom, sp.strand, e_start, e_end, start_offset \"offset\" from ex e join sp on sp.gene_id = e.gene_id and sp.transcript_id = e.transcript_id")
def a11(s, d):
    return exported(s, d).select("gene_id", "transcript_id", "chrom", "strand", "e_start", "e_end", "offset")


@query("a14_alleles", f"select annotation_id, case when u in ('N', '-', '') then u when annotation_id % 2 = 0 then reverse(case when regexp_full_match(u, '[ACGTUMRWSYKVHDBN.-]*') then translate(u, 'ACGTUMRWSYKVHDBN.-', 'TGCAAKYWSRMBDHVN.-') else u end) else u end \"ref\" from (select annotation_id, upper(c) u from ({ANN}) where c is not null)")
def a14(s, d):
    a = ann(s, d).where("c is not null").withColumn("ref", F.lower("c")).withColumn("alt", F.col("c")).withColumn("strand", F.when(F.col("annotation_id") % 2 == 0, "-").otherwise("+"))
    return A.alleles(a, True).select("annotation_id", "ref")


@query("b02_spliced_sequences", "with " + SEQS + ", e as (select doc_id, substr(q, cast(n // 6 + 1 as bigint), cast(n // 3 - n // 6 as bigint)) || substr(q, cast(n // 2 + 1 as bigint), cast(n - n // 6 - n // 2 as bigint)) q from (select doc_id, q, length(q) n from ss) where n >= 6) select cast(doc_id as varchar) transcript_id, case when doc_id % 2 = 0 then reverse(translate(q, 'ACGT', 'TGCA')) else q end spliced from e")
def b02(s, d):
    """Two exons over most of each text, so that they cross chunks."""
    c = contigs(s, d).where("length(seq) >= 6").withColumn("n", F.length("seq").cast("long"))
    part = lambda a, b: F.struct(F.expr(a).alias("e_start"), F.expr(b).alias("e_end"))
    e = c.select("doc_id", "chrom", F.explode(F.array(part("n div 6", "n div 3"), part("n div 2", "n - n div 6"))).alias("x")).select(F.col("chrom").alias("gene_id"), F.col("chrom").alias("transcript_id"), "chrom", F.when(F.col("doc_id") % 2 == 0, "-").otherwise("+").alias("strand"), "x.*")
    o = E.with_offsets(e).withColumn("r", F.concat_ws("/", "transcript_id", "e_start"))
    chunks = tables.chunked(c.select("chrom", F.lit(0).cast("long").alias("at"), "seq"), 256)
    return A.spliced(o, tables.fetch(chunks, o, "r", "e_start", "e_end", 256)).select("transcript_id", "spliced")


@query(
    "j08_effects",
    ORACLES["h15_splice_distance"].rsplit("select r.site_id", 1)[0] + """, y as (select r.*, z.x, case when region = 'CDS' then 'IncompleteTranscript' else region end kind from reg r left join z on z.site_id = r.site_id and z.gene_id = r.gene_id and z.transcript_id = r.transcript_id and z.ts = r.ts and n = 1 where transcript_pos is not null),
    b as (select *, row_number() over (partition by site_id order by case kind when 'ThreePrimeUTR' then 0 when 'FivePrimeUTR' then 1 when 'IncompleteTranscript' then 2 else 3 end, lo, hi, gene_id, transcript_id) k from y)
    select site_id, kind mut_type, gene_id gene_name, transcript_id transcript_name, transcript_pos, x distance2splice from b where k = 1""",
)
def j08(s, d):
    v = sites(s, d).withColumn("ref", F.lit("A")).withColumn("alt", F.lit("G"))
    return A.as_effects(A.annotate(v, exons(s, d), exon_only=True)).select("site_id", "mut_type", "gene_name", "transcript_name", "transcript_pos", "distance2splice")


@query(
    "j05_best_features",
    BASE + """, f as (select ord, seqname, strand, start - 1 s, "end" e, transcript_id, feature from fr where feature in ('exon', 'CDS') and start <= "end"), h as (select site_id, transcript_id transcript, feature "type", case when f.strand = '-' then e - (pos - 0.5::double) else pos - 0.5::double - s end / (e - s) relative, row_number() over (partition by site_id order by ord) n from si join f on si.chrom = f.seqname and s < pos and pos <= e)
    select site_id, transcript, "type", cast(1 as bigint) overlap, round(relative, 6) relative from h where n = 1""",
)
def j05(s, d):
    f = gtf_rows(s, d).where("feature in ('exon', 'CDS') and start <= end").select(F.col("seqname").alias("chrom"), F.col("strand").alias("f_strand"), (F.col("start") - 1).alias("f_start"), F.col("end").alias("f_end"), F.col("ord").alias("feature_idx"), F.col("transcript_id").alias("transcript"), F.col("feature").alias("type"))
    return M.annotate_with_features(spans(s, d), f, "site_id").select("site_id", "transcript", "type", "overlap", F.round("relative", 6).alias("relative"))


QC = BASE + f""", a0 as (select annotation_id i, min(chrom) chrom, min(pos) - 1 p from annotation where pos is not null and chrom is not null group by 1),
rd0 as (select i, e, i * 2 + e "read", chrom, case when e = 0 then p else p + i % 60 end p, (case when e = 0 then 99 else 147 end) + case when i % 5 = 0 then 1024 else 0 end f, case when i % 11 = 0 then 10 else 255 end q, (i + e) % 9 nm, i % 60 + 50 size, i % 3 = 0 and e = 0 spliced from a0, (values (0), (1)) v(e)),
rd as (select *, 50 b, case when spliced then 2 else 1 end k, nm <= 6 and q >= 255 hq, i % 5 = 0 dup from rd0),
g0 as (select *, start - 1 s, coalesce(lower(gene_biotype) like '%rrna%' or lower(gene_biotype) like '%ribosomal%', false) or coalesce(lower(gene_name) like '%rrna%' or lower(gene_name) like '%ribosomal%', false) ribo from pr),
gf as (select gene_id, first(seqname order by ord) chrom, first(strand order by ord) strand, first(gene_name order by ord) gene_name, coalesce(min(case when feature = 'gene' then s end), min(case when feature = 'exon' then s end)) a, coalesce(max(case when feature = 'gene' then "end" end), max(case when feature = 'exon' then "end" end)) z,
  coalesce(sum(case when feature = 'exon' then "end" - s end), 0) len, bool_or(ribo) ribo from g0 group by 1),
e0 as (select *, row_number() over (partition by gene_id order by s, "end", ord) - 1 n from g0 where feature = 'exon'),
ef as (select *, gene_id || '_' || n exon_id, coalesce(sum("end" - s) over (partition by gene_id order by case when strand = '-' then -n else n end rows between unbounded preceding and 1 preceding), 0) o from e0),
kb0 as (select "read", 0 bn, chrom, p bs, p + case when spliced then 20 else 50 end be from rd union all select "read", 1, chrom, p + 20 + i % 500, p + 50 + i % 500 from rd where spliced),
kb as (select * from kb0 where chrom in (select chrom from gf)),
px as (select kb."read", bn, bs, be, ef.gene_id, exon_id, ef.strand, ef.ribo, s, "end" z, o, s <= bs and be <= "end" "full" from kb join ef on kb.chrom = ef.seqname and bs < ef."end" and s < be),
kn as (select "read", count(*) n from kb group by 1),
ua as (select px."read", gene_id from px join kn on kn."read" = px."read" where "full" group by 1, 2, n having count(distinct bn) = n),
bo as (select distinct kb."read", gf.strand, gf.ribo from kb join gf on kb.chrom = gf.chrom and bs < z and a < be),
cl as (select kn."read", case when kn."read" in (select "read" from ua) then 'x' when kn."read" in (select "read" from px) then 'a' when kn."read" in (select "read" from bo) then 'i' else 'g' end c from kn),
ch as (select c, count(*) n, count(case when hq then 1 end) h from cl join rd on rd."read" = cl."read" group by 1),
mt as (select "read", bool_or(strand = '+') pl, bool_or(strand = '-') mi, bool_or(ribo) ribo from (select "read", strand, ribo from px union all select "read", strand, ribo from bo) group by 1),
se as (select count(case when ribo then 1 end) rr, count(case when pl <> mi and e = 0 then 1 end) e1, count(case when pl <> mi and e = 0 and pl then 1 end) s1, count(case when pl <> mi and e = 1 then 1 end) e2, count(case when pl <> mi and e = 1 and mi then 1 end) s2 from mt join rd on rd."read" = mt."read"),
gc as (select gene_id, count(case when not dup then 1 end) u from ua join rd on rd."read" = ua."read" where hq group by 1),
ng as (select count(*) n, count(case when dup then 1 end) d from (select ua."read", rd.dup from ua join rd on rd."read" = ua."read" join gf on gf.gene_id = ua.gene_id where hq group by 1, 2 having not bool_or(coalesce(gene_name in ({', '.join(repr(g) for g in Q.GLOBINS)}), false)))),
el as (select gf.gene_id, cast(len as bigint) len from gf join gc on gc.gene_id = gf.gene_id where u >= 5 and len >= 600),
cv as (select px.gene_id, o + case when px.strand = '+' then bs - s else z - be end c, be - bs w from px join rd on rd."read" = px."read" where "full" and hq and px."read" in (select "read" from ua)),
ws as (select gene_id, k, case when k = 5 then 150 + j else len - 250 + j end p from el, (values (3), (5)) v(k), range(100) r(j)),
dp as (select ws.gene_id, k, p, count(c) n from ws left join cv on cv.gene_id = ws.gene_id and c <= p and p < c + w group by 1, 2, 3),
md as (select gene_id, k, median(n) m from dp group by 1, 2),
bi as (select m3 / (m3 + m5) x from (select gene_id, max(case when k = 3 then m end) m3, max(case when k = 5 then m end) m5 from md group by 1) where m3 + m5 > 0),
fh as (select px."read", min(exon_id) x from px join kn on kn."read" = px."read" where "full" group by 1, n having count(distinct exon_id) = 1 and count(distinct bn) = n),
fs as (select min(size) x from fh join rd on rd."read" = fh."read" where hq group by i, fh.x having count(*) = 2),
bm as (select median(x) m from bi), fm as (select median(x) m from fs),
t as (select count(*) n, count(case when dup then 1 end) d, count(case when hq then 1 end) h, sum(nm) nm, sum(b) b, sum(k) k, count(case when e = 0 and not dup then 1 end) uf, count(case when e = 0 and dup then 1 end) df, sum(case when e = 0 then nm end) n1, sum(case when e = 0 then b end) b1, sum(case when e = 1 then nm end) n2, sum(case when e = 1 then b end) b2, count(case when e = 0 then 1 end) c1 from rd),
w as (select coalesce(sum(case when c = 'x' then n end), 0) x, coalesce(sum(case when c = 'i' then n end), 0) i, coalesce(sum(case when c = 'g' then n end), 0) g, coalesce(sum(case when c = 'a' then n end), 0) a, coalesce(sum(case when c = 'x' then h end), 0) hx, coalesce(sum(case when c = 'i' then h end), 0) hi, coalesce(sum(case when c = 'g' then h end), 0) hg, coalesce(sum(case when c = 'a' then h end), 0) ha from ch),
m as (""" + " union all ".join(f"""select '{n.replace("'", "''")}' statistic, cast({v} as double) "value" from {f}""" for n, v, f in (
    ("Mapping Rate", "1", "t"), ("Unique Rate of Mapped", "(n - d) / n", "t"), ("Duplicate Rate of Mapped", "d / n", "t"), ("Duplicate Rate of Mapped, excluding Globins", "d / n", "ng"), ("Base Mismatch", "nm / b", "t"), ("End 1 Mapping Rate", "2 * c1 / n", "t"), ("End 2 Mapping Rate", "2 * (n - c1) / n", "t"),
    ("End 1 Mismatch Rate", "n1 / b1", "t"), ("End 2 Mismatch Rate", "n2 / b2", "t"), ("Expression Profiling Efficiency", "x / n", "w, t"), ("High Quality Rate", "h / n", "t"), ("Exonic Rate", "x / n", "w, t"), ("Intronic Rate", "i / n", "w, t"), ("Intergenic Rate", "g / n", "w, t"), ("Intragenic Rate", "(x + i) / n", "w, t"),
    ("Ambiguous Alignment Rate", "a / n", "w, t"), ("High Quality Exonic Rate", "hx / h", "w, t"), ("High Quality Intronic Rate", "hi / h", "w, t"), ("High Quality Intergenic Rate", "hg / h", "w, t"), ("High Quality Intragenic Rate", "(hx + hi) / h", "w, t"), ("High Quality Ambiguous Alignment Rate", "ha / h", "w, t"),
    ("Discard Rate", "0", "t"), ("rRNA Rate", "rr / n", "se, t"), ("End 1 Sense Rate", "s1 / e1", "se"), ("End 2 Sense Rate", "s2 / e2", "se"), ("Avg. Splits per Read", "k / n - 1", "t"), ("Read Length", "max(b)", "rd"), ("Genes Detected", "count(case when u >= 5 then 1 end)", "gc"),
    ("Genes used in 3' bias", "count(*)", "bi"), ("Mean 3' bias", "avg(x)", "bi"), ("Median 3' bias", "median(x)", "bi"), ("3' bias Std", "stddev_pop(x)", "bi"), ("3' bias MAD", "median(abs(x - m)) * 1.4826", "bi, bm"), ("3' Bias, 25th Percentile", "quantile_cont(x, 0.25)", "bi"), ("3' Bias, 75th Percentile", "quantile_cont(x, 0.75)", "bi"),
    ("Average Fragment Length", "avg(x)", "fs"), ("Fragment Length Median", "median(x)", "fs"), ("Fragment Length Std", "stddev_pop(x)", "fs"), ("Fragment Length MAD", "median(abs(x - m)) * 1.4826", "fs, fm"), ("Total Reads (Raw)", "n", "t"), ("Unique Mapping, Vendor QC Passed Reads (Raw)", "n", "t"), ("Mapped Reads (Raw)", "n", "t"),
    ("Mapped Unique Reads (Raw)", "n - d", "t"), ("Mapped Duplicate Reads (Raw)", "d", "t"), ("High Quality Reads (Raw)", "h", "t"), ("Exonic Reads (Raw)", "x", "w"), ("Intronic Reads (Raw)", "i", "w"), ("Intergenic Reads (Raw)", "g", "w"),
)) + """)
select statistic, case when isfinite("value") then round("value", 5) end "value" from m where "value" is not null and not (statistic like '%3'' %' and (select count(*) from bi) = 0) and not (statistic like '%Fragment%' and (select count(*) from fs) = 0)"""


def qc_reads(s, d):
    """Pairs made from annotation rows: the first read perhaps spliced, its mate up to 59 bases further on."""
    a = table(s, d, "annotation").where("pos is not null and chrom is not null").groupBy(F.col("annotation_id").alias("i")).agg(F.min("chrom").alias("rname"), (F.min("pos") - 1).alias("p"))
    i, e = F.col("i"), F.col("e")
    r = a.withColumn("e", F.explode(F.array(F.lit(0), F.lit(1))))
    cigar = F.when((i % 3 == 0) & (e == 0), F.concat(F.lit("20M"), (i % 500).cast("string"), F.lit("N30M"))).otherwise("50M")
    size = i % 60 + 50
    return r.select((i * 2 + e).alias("ord"), F.concat(F.lit("q"), i.cast("string")).alias("qname"), (F.when(e == 0, 99).otherwise(147) + F.when(i % 5 == 0, 1024).otherwise(0)).alias("flag"), "rname", F.when(e == 0, F.col("p")).otherwise(F.col("p") + i % 60).alias("pos"), F.when(i % 11 == 0, 10).otherwise(255).alias("mapq"), cigar.alias("cigar"),
        F.lit("=").alias("rnext"), F.col("p").alias("pnext"), F.when(e == 0, size).otherwise(-size).alias("tlen"), F.lit("A" * 50).alias("seq"), F.lit("I" * 50).alias("qual"), F.create_map(F.lit("NM"), F.concat(F.lit("i:"), ((i + e) % 9).cast("string"))).alias("tags"))


@query("j13_qc_metrics", QC)
def j13(s, d):
    """All statistics but the library's size, which is found by bisection (d26)."""
    rows = pruned(s, d).withColumnRenamed("seqname", "chrom").withColumn("start", F.col("start") - 1)
    m = Q.metrics(qc_reads(s, d), rows)[0].where("statistic <> 'Estimated Library Complexity'")
    return m.select("statistic", F.when(F.abs("value") < float("inf"), F.round("value", 5)).alias("value"))
