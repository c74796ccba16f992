"""Sequence functions as column expressions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# Complements, ambiguity codes and the standard genetic code (bases in the order U C A G).
IUPAC, IUPAC_COMPLEMENT = "ACGTUMRWSYKVHDBN.-", "TGCAAKYWSRMBDHVN.-"
EXPANSIONS = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT", "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT", "N": "GATC", ".": "GATC", "-": "GATC"}
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
STOP = "STOP"


def codons() -> dict[str, str]:
    """Codon to amino acid; a stop is the word STOP."""
    return {"".join(c): STOP if a == "*" else a for c, a in zip(product("UCAG", repeat=3), CODE, strict=True)}


def reverse_complement(s: Column) -> Column:
    """A, C, G and T are swapped in either case; all else stays; the whole is reversed."""
    return F.reverse(F.translate(s, "ACGTacgt", "TGCAtgca"))


def reverse_base(s: Column) -> Column:
    """Reverse complement with ambiguity codes; a text with any other sign (lower case too) is only reversed."""
    return F.reverse(F.when(s.rlike("^[ACGTUMRWSYKVHDBN.-]*\\z"), F.translate(s, IUPAC, IUPAC_COMPLEMENT)).otherwise(s))


def expand_base(b: Column) -> Column:
    """The bases an ambiguity code stands for; null for an unknown sign."""
    table = F.create_map(*[x for k, v in EXPANSIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.try_element_at(table, F.upper(b))


def convert_bases(s: Column, old: str, new: str) -> Column:
    """Replaces signs one for one, keeping the case; a header line (starting with >) stays."""
    return F.when(s.startswith(">"), s).otherwise(F.translate(s, old.upper() + old.lower(), new.upper() + new.lower()))


def to_rna(s: Column) -> Column:
    return F.translate(s, "T", "U")


def translate_codon(codon: Column) -> Column:
    """The amino acid of a codon of DNA or RNA letters, STOP for a stop; null when it can't be told."""
    table = F.create_map(*[F.lit(x) for kv in codons().items() for x in kv])
    return F.try_element_at(table, F.translate(F.upper(codon), "T", "U"))


def protein_text(cds: Column) -> Column:
    """The translation of whole codons, joined: a stop takes four letters, an unknown codon gives X."""
    # cut by a pattern: substr would look for each codon from the start of the text
    parts = F.transform(F.regexp_extract_all(cds, F.lit("(?s)..."), F.lit(0)), lambda k: F.coalesce(translate_codon(k), F.lit("X")))
    return F.array_join(parts, "")


def window_of(seq: Column, start: Column, end: Column, length: Column) -> Column:
    """seq[start:end] of a contig of the given length, N where the window leaves it."""
    a, b = F.greatest(start, F.lit(0)), F.least(end, length)
    inner = F.when(a < b, seq.substr((a + 1).cast("int"), (b - a).cast("int"))).otherwise("")
    left = F.greatest(F.lit(0), F.least(F.lit(0) - start, end - start))
    right = F.greatest(F.lit(0), F.least(end - length, end - start))
    n = lambda k: F.call_function("repeat", F.lit("N"), k.cast("int"))
    return F.concat(n(left), inner, n(right))


def mark_site(motif: Column, strand: Column, left: int, right: int) -> Column:
    """The motif with its site in square brackets: behind `left` bases, on the minus strand behind `right`."""
    before = F.when(strand == "-", right).otherwise(left)
    return F.concat(motif.substr(F.lit(1), before), F.lit("["), motif.substr(before + 1, F.lit(1)), F.lit("]"), motif.substr(before + 2, F.length(motif)))


def padded_motif(seq: Column, pos: Column, pad: int) -> Column:
    """`pad` bases, the base at 0-based pos and `pad` more of a spliced sequence, N where it ends."""
    return window_of(seq, pos - pad, pos + pad + 1, F.length(seq).cast("long"))
