"""Queries on the operators of this package (p4, p7 to p9)."""

from __future__ import annotations

from strandloom.llm import mixing, sentences, tokenizer, toprank

QUERIES = {
    "p4_found": toprank.found,
    "p4_longest": toprank.spread,
    "p7_ids": tokenizer.ids,
    "p7_roundtrip": tokenizer.roundtrip,
    "p8_found": mixing.found,
    "p8_copies": mixing.mixed,
    "p8_report": mixing.report,
    "p9_found": sentences.found,
    "p9_lengths": sentences.lengths,
}

RANKED = "select upper(trim(gene_id)) gene_id, upper(trim(transcript_id)) transcript_id, min(transcript_level) l, max(transcript_length) n from exon_ref where gene_id is not null and transcript_id is not null group by 1, 2"

#: Encodings, rates and sentences can't be told in SQL; tests hold them against brute force. A round trip can.
ORACLES = {
    "p7_roundtrip": "select doc_id, true same from documents",
    "p4_found": f"select gene_id, transcript_id, place from (select *, row_number() over (partition by gene_id order by l nulls last, n desc nulls last, transcript_id) place from ({RANKED})) where place <= 3",
    "p4_longest": """select chromosome, transcript_id, place from (select *, row_number() over (partition by chromosome order by n desc nulls last, transcript_id) place from
        (select upper(trim(chromosome)) chromosome, upper(trim(transcript_id)) transcript_id, max(transcript_length) n from exon_ref where chromosome is not null and transcript_id is not null group by 1, 2)) where place <= 5""",
}
