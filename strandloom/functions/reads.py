"""Functions on aligned reads: flags, CIGARs and mismatch texts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The bits of a read's flag.
FLAGS = {"paired": 1, "proper_pair": 2, "unmapped": 4, "mate_unmapped": 8, "reverse": 16, "mate_reverse": 32, "read1": 64, "read2": 128, "secondary": 256, "qcfail": 512, "duplicate": 1024, "supplementary": 2048}
CIGAR = r"(\d+)([MIDNSHP=X])"


def has_flag(flag: Column, name: str) -> Column:
    return flag.bitwiseAND(FLAGS[name]) != 0


def flip_flag(flag: Column) -> Column:
    """The flag on the other strand: both mates' strands change for a paired read."""
    return F.when(has_flag(flag, "paired"), flag.bitwiseXOR(48)).otherwise(flag.bitwiseXOR(16))


def cigar_ops(cigar: Column) -> Column:
    """array<struct<op, len>>."""
    sizes, ops = (F.regexp_extract_all(cigar, F.lit(CIGAR), F.lit(g)) for g in (1, 2))
    return F.transform(F.arrays_zip(ops.alias("o"), sizes.alias("s")), lambda x: F.struct(x["o"].alias("op"), x["s"].cast("long").alias("len")))


def reference_blocks(cigar: Column, start: Column) -> Column:
    """The stretches of the reference a read covers (M, =, X), as array<struct<b_start, b_end>>; D and N part them."""
    state = F.struct(start.cast("long").alias("at"), F.array().cast("array<struct<b_start:bigint,b_end:bigint>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        covers, moves = x["op"].isin("M", "=", "X"), x["op"].isin("M", "=", "X", "N", "D")
        end = s["at"] + x["len"]
        return F.struct(F.when(moves, end).otherwise(s["at"]).alias("at"), F.when(covers, F.array_append(s["out"], F.struct(s["at"].alias("b_start"), end.alias("b_end")))).otherwise(s["out"]).alias("out"))

    return F.aggregate(cigar_ops(cigar), state, step, lambda s: s["out"])


def reference_end(cigar: Column, start: Column) -> Column:
    return F.aggregate(cigar_ops(cigar), start.cast("long"), lambda a, x: a + F.when(x["op"].isin("M", "=", "X", "N", "D"), x["len"]).otherwise(F.lit(0)))


def query_length(cigar: Column) -> Column:
    return F.aggregate(cigar_ops(cigar), F.lit(0).cast("long"), lambda a, x: a + F.when(x["op"].isin("M", "=", "X", "I", "S"), x["len"]).otherwise(F.lit(0)))


def reverse_cigar(cigar: Column) -> Column:
    return F.array_join(F.transform(F.reverse(cigar_ops(cigar)), lambda x: F.concat(x["len"].cast("string"), x["op"])), "")


_SWAP = str.maketrans("ACGTacgt", "TGCAtgca")


def reversed_md(md: str | None) -> str | None:
    """A mismatch text for the read turned round: tokens in reverse order, bases complemented, one number between any two changes."""
    if not md:
        return md
    out, number = [], None
    for t in reversed(re.findall(r"\d+|\^[A-Za-z]+|[A-Za-z]", md)):
        if t.isdigit():
            number = (number or 0) + int(t)
            continue
        out += [str(number or 0), ("^" + t[:0:-1] if t[0] == "^" else t).translate(_SWAP)]
        number = None
    return "".join([*out, str(number or 0)])


def reverse_md(md: Column | str) -> Column:
    """reversed_md as a column expression."""
    md = F.col(md) if isinstance(md, str) else md
    tokens = F.reverse(F.regexp_extract_all(md, F.lit(r"\d+|\^[A-Za-z]+|[A-Za-z]"), F.lit(0)))
    swap = lambda t: F.translate(t, "ACGTacgt", "TGCAtgca")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("n"))

    def step(s: Column, t: Column) -> Column:
        turned = F.when(t.startswith("^"), F.concat(F.lit("^"), F.reverse(F.substring(t, 2, 1 << 30)))).otherwise(t)
        digit = t.rlike("^[0-9]")
        return F.struct(F.when(digit, s["out"]).otherwise(F.concat(s["out"], s["n"].cast("string"), swap(turned))).alias("out"), F.when(digit, s["n"] + t.try_cast("bigint")).otherwise(F.lit(0).cast("long")).alias("n"))

    return F.when(md == "", md).otherwise(F.aggregate(tokens, start, step, lambda s: F.concat(s["out"], s["n"].cast("string"))))


def score_read(cigar: str, seq: str, ref: str, plus: bool) -> tuple:
    """(score, mismatches, md, yf, zf, yc, zc, ns, nc) of a read against the reference it spans.

    The conversions A>G and C>T (plus; T>C and G>A otherwise) are expected and score 1 like a match; another
    mismatch scores -1, an inserted or deleted base too. yf and yc count the two conversions (to G or A, to T
    or C), zf and zc the bases A and C (T and G) that stayed; ns counts other mismatches, nc inserted,
    clipped and deleted bases. A read whose length doesn't fit the CIGAR scores -999.
    """
    kept = ("A", "C") if plus else ("T", "G")
    expected = {("A", "G"): "yf", ("C", "T"): "yc"} if plus else {("G", "A"): "yf", ("T", "C"): "yc"}
    n = dict.fromkeys(("same", "yf", "yc", "zf", "zc", "ns", "nc", "gaps"), 0)
    md, run, q, r = [], 0, 0, 0
    for size, op in ((int(a), b) for a, b in re.findall(CIGAR, cigar)):
        if op in "M=X":
            for want, got in zip(ref[r : r + size], seq[q : q + size], strict=False):
                if want == got:
                    run, n["same"] = run + 1, n["same"] + 1
                    if got in kept:
                        n["zf" if got == kept[0] else "zc"] += 1
                else:
                    n[expected.get((want, got), "ns")] += 1
                    md.append(f"{run}{want}")
                    run = 0
            q, r = q + size, r + size
        elif op in "IS":
            q, n["nc"], n["gaps"] = q + size, n["nc"] + size, n["gaps"] + size * (op == "I")
        elif op == "D":
            md.append(f"{run}^{ref[r : r + size]}")
            run, r, n["nc"], n["gaps"] = 0, r + size, n["nc"] + size, n["gaps"] + size
        elif op == "N":
            r += size
    if q != len(seq):
        return (-999, 999, None, 0, 0, 0, 0, 0, 0)
    return (n["same"] + n["yf"] + n["yc"] - n["ns"] - n["gaps"], n["ns"], "".join([*md, str(run)]), n["yf"], n["zf"], n["yc"], n["zc"], n["ns"], n["nc"])


SCORED = T.StructType([T.StructField(c, T.StringType() if c == "md" else T.IntegerType()) for c in ("score", "mismatches", "md", "yf", "zf", "yc", "zc", "ns", "nc")])


@F.pandas_udf(SCORED)
def score_reads(cigar: pd.Series, seq: pd.Series, ref: pd.Series, plus: pd.Series) -> pd.DataFrame:
    rows = [score_read(*x) if all(isinstance(v, str) for v in x[:3]) else (None,) * 9 for x in zip(cigar, seq, ref, plus, strict=True)]
    return pd.DataFrame(rows, columns=SCORED.names)
