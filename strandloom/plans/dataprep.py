"""Queries on the data-preparation operators of the core (p1 to p3, p5 and p6), with the same in SQL."""

from __future__ import annotations

from strandloom.operators import chunking, lineparse, orphans, runbitmap, unpack

QUERIES = {
    "p1_found": orphans.found,
    "p1_report": orphans.report,
    "p1_composite": orphans.composite,
    "p2_found": unpack.found,
    "p2_separators": unpack.separators,
    "p2_by_key": unpack.by_key,
    "p3_found": runbitmap.found,
    "p3_coverage": runbitmap.coverage,
    "p5_found": chunking.found,
    "p5_profiles": chunking.profiles,
    "p6_found": lineparse.found,
    "p6_sites": lineparse.sites,
    "p6_features": lineparse.features,
}

P1 = """with names as (select upper(trim(name)) k, added_at a, retired_at b from contig),
also as (select upper(trim(alias)) k, upper(trim(name)) n from chrom_alias where alias is not null),
contigs as (select * from names union all select also.k, names.a, names.b from also join names on names.k = also.n where also.k not in (select k from names)),
targets as (select 'g' w, upper(trim(gene_id)) k, loaded_at a, deleted_at b from gene where gene_id is not null
  union all select 't', upper(trim(transcript_id)), loaded_at, deleted_at from transcript where transcript_id is not null
  union all select 'c', k, a, b from contigs),
refs as (select 'transcript' child_table, upper(trim(transcript_id)) child_key, 'gene_id' ref_field, 'g' w, upper(trim(gene_id)) k, loaded_at t from transcript
  union all select 'annotation', cast(annotation_id as varchar), 'gene_id', 'g', upper(trim(gene_id)), loaded_at from annotation
  union all select 'feature', cast(feature_id as varchar), 'transcript_id', 't', upper(trim(transcript_id)), loaded_at from feature
  union all select 'feature', cast(feature_id as varchar), 'seqname', 'c', upper(trim(seqname)), loaded_at from feature),
known as (select w, k, min(a) a from targets group by w, k),
lost as (select r.*, n.a, n.k nk from refs r left join known n on n.w = r.w and n.k = r.k where r.k is not null
  and not exists (select 1 from targets x where x.w = r.w and x.k = r.k and x.a <= r.t and (x.b is null or x.b > r.t))),
found as (select distinct child_table, child_key, ref_field, case when nk is null then 'missing' when a > t then 'late' else 'deleted' end status, strftime(t, '%Y-%m') period from lost) """

P2 = r"""with s as (select 'liftover_annot' src_table, annot_id row_id, unnest(regexp_extract_all(spans, '[0-9]+[^0-9]+[0-9]+')) v, generate_subscripts(regexp_extract_all(spans, '[0-9]+[^0-9]+[0-9]+'), 1) item_no from liftover_annot where spans is not null),
a as (select feature_id row_id, list_filter(list_transform(regexp_extract_all(attributes, '(?:[^;,|"]|"[^"]*")+'), lambda x: trim(x)), lambda x: x <> '') items from feature where attributes is not null and trim(attributes) not in ('', '.')),
b as (select row_id, unnest(items) v, generate_subscripts(items, 1) item_no from a),
c as (select row_id, item_no, regexp_extract(v, '^([^\s=]+)', 1) k, regexp_replace(v, '^[^\s=]+(\s*=\s*|\s+)', '') v from b),
found as (select src_table, row_id, cast(item_no as bigint) item_no, 'span' item_key, regexp_replace(v, '[^0-9]+', '-') item_value from s
union all select 'feature', row_id, cast(item_no as bigint), k, case when length(v) >= 2 and v[1] = '"' and v[-1] = '"' then v[2:-2] else v end from c) """

P3 = """with r as (select upper(trim(transcript_id)) t, start s, "end" e from feature where transcript_id is not null and feature not in ('gene', 'transcript') and start <= "end"),
m as (select *, max(e) over (partition by t order by s, e rows between unbounded preceding and 1 preceding) b from r),
i as (select *, sum(case when b is null or s > b + 1 then 1 else 0 end) over (partition by t order by s, e rows unbounded preceding) n from m),
p as (select t, n, min(s) s, max(e) e from i group by t, n),
g as (select t, lag(e) over (partition by t order by s) + 1 s, s - 1 e from p),
found as (select t transcript_id, 'period' kind, s start_pos, e end_pos from p union all select t, 'gap', s, e from g where s is not null) """

SITE_OK = r"""(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)"""
P6 = rf"""with s0 as (select line_no, regexp_replace(line, '\r$', '') l from site_lines),
s1 as (select line_no, l from s0 where l is not null and trim(l, e' \t\r\n') <> '' and l[1] <> '#'),
s2 as (select line_no, l, regexp_full_match(l, '{SITE_OK}(?:\t{SITE_OK})*') ok from s1),
s3 as (select line_no, ok, list_transform(regexp_extract_all(chr(9) || l, '\t((?:"(?:[^"]|"")*"|[^"\t][^\t]*|))', 1), lambda x: case when x[1] = '"' then replace(x[2:-2], '""', '"') else x end) f from s2),
s4 as (select line_no, case when not ok then 'quoting' when len(f) <> 6 then 'column_count'
  when trim(f[1]) = '' or not regexp_full_match(f[2], '[0-9]+') or coalesce(try_cast(f[2] as decimal(38, 0)), 0) not between 1 and 2147483647 or f[3] not in ('+', '-', '.')
  or not regexp_full_match(f[4], '[ACGTNacgtn]+|[.-]') or not regexp_full_match(f[5], '[ACGTNacgtn]+|[.-]') then 'value' end reason, f from s3),
f0 as (select line_no, regexp_replace(line, '\r$', '') l from feature_lines),
f1 as (select line_no, string_split(l, chr(9)) f from f0 where l is not null and trim(l, e' \t\r\n') <> '' and l[1] <> '#'),
f2 as (select line_no, case when len(f) <> 9 then 'column_count' when not regexp_full_match(f[9], '[^"]*(?:"[^"]*" *(?:;[^"]*|$))*') then 'quoting'
  when not regexp_full_match(f[4], '[0-9]+') or coalesce(try_cast(f[4] as decimal(38, 0)), 0) not between 1 and 2147483647
  or not regexp_full_match(f[5], '[0-9]+') or coalesce(try_cast(f[5] as decimal(38, 0)), 0) not between 1 and 2147483647
  or try_cast(f[4] as bigint) > try_cast(f[5] as bigint) or not regexp_full_match(f[6], '\.|[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)')
  or f[7] not in ('+', '-', '.') or f[8] not in ('.', '0', '1', '2')
  or not regexp_matches(';' || regexp_replace(f[9], '"[^"]*[^"\s][^"]*"', '""Q""', 'g'), ';\s*gene_id(?:\s*=\s*|\s+)(?:""Q""|[^\s;"])') then 'value' end reason, f from f1) """

PROFILE = """with r as (select upper(trim(gene_id)) gene_id, annotation_id, region, pos from annotation where gene_id is not null),
w as (select *, lag(region) over o p, row_number() over o i from r window o as (partition by gene_id order by annotation_id nulls first, region nulls first, pos nulls first))
select gene_id, count(*) "rows", cast(sum(pos) as bigint) value_sum, min(pos) value_min, max(pos) value_max, cast(sum(case when i > 1 and region is distinct from p then 1 else 0 end) as bigint) changes from w group by gene_id"""

ORACLES = {
    "p1_found": P1 + "select * from found",
    "p1_report": P1 + "select child_table, ref_field, status, period, count(*) orphans from found group by all",
    "p1_composite": """select distinct upper(trim(transcript_id)) transcript_id, upper(trim(gene_id)) gene_id, upper(trim(seqname)) seqname, strand, 'missing' status from transcript t
        where not (gene_id is null and seqname is null and strand is null) and not exists (select 1 from gene g where (t.gene_id is null or upper(trim(g.gene_id)) = upper(trim(t.gene_id)))
        and (t.seqname is null or upper(trim(g.seqname)) = upper(trim(t.seqname))) and (t.strand is null or upper(trim(g.strand)) = upper(trim(t.strand))))""",
    "p2_found": P2 + "select * from found",
    "p2_by_key": P2 + "select item_key, count(*) items, count(distinct upper(trim(item_value))) item_values from found where src_table = 'feature' group by item_key",
    "p3_found": P3 + "select * from found",
    "p3_coverage": P3 + """select transcript_id, cast(sum(case when kind = 'period' then 1 else 0 end) as bigint) periods, cast(sum(case when kind = 'period' then end_pos - start_pos + 1 else 0 end) as bigint) period_positions,
        cast(sum(case when kind = 'gap' then 1 else 0 end) as bigint) gaps, cast(sum(case when kind = 'gap' then end_pos - start_pos + 1 else 0 end) as bigint) gap_positions from found group by transcript_id""",
    "p5_found": """select 'annotation' src_table, upper(trim(gene_id)) key_value from annotation where gene_id is not null group by 2 having count(*) >= 0.03 * (select count(*) from annotation)
        union all select 'feature', upper(trim(seqname)) from feature where seqname is not null group by 2 having count(*) >= 0.03 * (select count(*) from feature)""",
    "p5_profiles": PROFILE,
    "p6_found": P6 + "select 'site_lines' src_table, line_no, reason from s4 where reason is not null union all select 'feature_lines', line_no, reason from f2 where reason is not null",
    "p6_sites": P6 + "select line_no, f[1] chrom, cast(f[2] as bigint) pos, f[3] strand, f[4] ref, f[5] alt, f[6] note from s4 where reason is null",
    "p6_features": P6 + """select line_no, f[1] seqname, f[2] source, f[3] feature, cast(f[4] as bigint) start, cast(f[5] as bigint) "end", f[6] score, f[7] strand, f[8] frame, f[9] attributes from f2 where reason is null""",
}
