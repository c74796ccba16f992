"""Between genome and transcript coordinates: tables of positions, and aligned reads."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.reads import CIGAR, reversed_md
from strandloom.operators.intervals import overlap_pairs
from strandloom.operators.skew import keyed_left_join

DROPPED_TO_GENOME = ("SA", "XA")
DROPPED_TO_TRANSCRIPT = ("NM", "MD", "AS", "XS", "YS", "XA", "SA", "XC")


# The decimal digits of other scripts, as numbers are read.
DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९０１２３４５６７８９"
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def position(c: Column) -> Column:
    """A position text as a number, digits of any script and _ between digits allowed; blank, non-numeric and non-finite ones
    and those beyond 64 bits give -1, decimals are cut."""
    ascii_ = F.translate(F.btrim(c, F.lit(" \t\r\n\f\x0b\u00a0\u3000")), DIGITS, "0123456789" * (len(DIGITS) // 10))
    plain = F.regexp_replace(ascii_, "(?<=[0-9])_(?=[0-9])", "")
    d = F.when(plain.rlike(NUMBER), plain.try_cast("double"))
    return F.coalesce(F.when(F.abs(d) < float(1 << 63), d.try_cast("bigint")), F.lit(-1))


def first_transcripts(tx: DataFrame) -> DataFrame:
    """Of each gene the first transcript (smallest ord)."""
    return tx.groupBy("gene_id").agg(F.min_by(F.struct("transcript_id", "chrom", "strand", "exons"), "ord").alias("t")).select("gene_id", "t.*")


def table_to_genome(rows: DataFrame, tx: DataFrame, record: str) -> DataFrame:
    """rows (record, gene_id, tx_pos 1-based) with chrom, pos (1-based) and strand of the gene's first transcript; unmapped ones have nulls."""
    from strandloom.plans.annotate import genome_pos

    one = first_transcripts(tx).withColumnRenamed("gene_id", "_g")
    joined = keyed_left_join(rows.withColumn("_g", F.col("gene_id")), one, "_g", [record])
    p = genome_pos(F.col("exons"), F.col("strand"), position(F.col("tx_pos")) - 1) + 1
    return joined.withColumn("pos", p).withColumn("chrom", F.when(F.col("pos").isNotNull(), F.col("chrom"))).withColumn("strand", F.when(F.col("pos").isNotNull(), F.col("strand"))).drop("_g", "exons", "transcript_id")


def table_to_transcript(rows: DataFrame, exons: DataFrame, record: str) -> DataFrame:
    """rows (record, chrom, pos 1-based) with gene_id, transcript_id and tx_pos (1-based) of the first transcript in
    the annotation's order (ord, exon_no) whose exon holds the position; the strand isn't compared."""
    left = rows.withColumn("_p", position(F.col("pos")) - 1)
    right = exons.select("chrom", "e_start", "e_end", "offset", F.col("strand").alias("e_strand"), "gene_id", "transcript_id", "ord", "exon_no")
    pairs = overlap_pairs(left.select(record, "chrom", "_p"), right, ["chrom"], ("_p", None), ("e_start", "e_end"), [record])
    t = F.when(F.col("e_strand") == "-", F.col("e_end") - 1 - F.col("_p")).otherwise(F.col("_p") - F.col("e_start")) + F.col("offset") + 1
    best = pairs.withColumn("tx_pos", t).groupBy(record).agg(F.min_by(F.struct("gene_id", "transcript_id", "tx_pos"), F.struct("ord", "exon_no")).alias("b")).select(record, "b.*")
    return rows.join(best, record, "left")


def keyed_transcripts(tx: DataFrame) -> DataFrame:
    """Transcripts by the names a read may carry: the transcript's, or the gene's when it has one transcript only."""
    own = tx.withColumn("key", F.col("transcript_id"))
    single = tx.groupBy("gene_id").agg(F.count("*").alias("_n")).where("_n = 1").select("gene_id")
    other = tx.join(single, "gene_id").withColumn("key", F.col("gene_id")).join(own.select("key").distinct(), "key", "left_anti")
    return own.unionByName(other)


def pick_transcript(blocks: DataFrame, exons: DataFrame) -> DataFrame:
    """(read, transcript_id): of the transcripts whose exons a read's blocks overlap, one that holds all blocks, then
    the one with most bases in common, then the first of the annotation (ord).
    blocks: read, chrom, b_start, b_end. exons: chrom, e_start, e_end, transcript_id, ord."""
    pairs = overlap_pairs(blocks.withColumn("_b", F.struct("b_start", "b_end")), exons.select("chrom", "e_start", "e_end", "transcript_id", "ord"), ["chrom"], ("b_start", "b_end"), ("e_start", "e_end"), ["read"])
    inside = (F.col("e_start") <= F.col("b_start")) & (F.col("b_end") <= F.col("e_end"))
    per_block = pairs.groupBy("read", "transcript_id", "ord", "_b").agg(F.max(inside).alias("held"), F.sum(F.least("b_end", "e_end") - F.greatest("b_start", "e_start")).alias("bases"))
    per_tx = per_block.groupBy("read", "transcript_id", "ord").agg(F.sum(F.col("held").cast("long")).alias("held"), F.sum("bases").alias("bases"))
    total = blocks.groupBy("read").agg(F.count("*").alias("blocks"))
    scored = per_tx.join(total, "read").withColumn("score", F.col("bases") + F.when(F.col("held") == F.col("blocks"), 1_000_000_000).otherwise(0))
    return scored.groupBy("read").agg(F.max_by("transcript_id", F.struct("score", -F.col("ord"))).alias("transcript_id"))


_SWAP = str.maketrans("ACGTacgt", "TGCAtgca")


def parse_cigar(cigar: str) -> list[tuple[str, int]]:
    return [(op, int(n)) for n, op in re.findall(CIGAR, cigar or "")]


def format_cigar(ops: list[tuple[str, int]]) -> str:
    """Neighbouring operations of a kind are joined, empty ones left out."""
    out: list[list] = []
    for op, n in ops:
        if n <= 0:
            continue
        if out and out[-1][0] == op:
            out[-1][1] += n
        else:
            out.append([op, n])
    return "".join(f"{n}{op}" for op, n in out) or "*"


def flipped(flag: int) -> int:
    return flag ^ 48 if flag & 1 else flag ^ 16


def running(exons: list[tuple[int, int]]) -> tuple[list[tuple[int, int, int]], int]:
    """The exons in genome order with the bases before each, and the bases of all."""
    flat, length = [], 0
    for s, e in sorted(exons):
        flat.append((s, e, length))
        length += e - s
    return flat, length


def _at(flat: list, tpos: int) -> tuple[int, int] | None:
    """(exon number, genome position) of a position on the exons in genome order."""
    i = bisect_right(flat, tpos, key=lambda x: x[2]) - 1
    while i >= 0 and flat[i][1] <= flat[i][0]:
        i -= 1
    if i < 0 or tpos - flat[i][2] >= flat[i][1] - flat[i][0]:
        return None
    return i, flat[i][0] + tpos - flat[i][2]


def mate_on_transcript(pos: int, size: int, exons: list[tuple[int, int]], strand: str) -> int | None:
    """The mate's position on the transcript, None when it isn't in an exon. On a minus transcript its end is taken to lie
    as many bases off as the read is long, as a read doesn't tell its mate's length."""
    flat, length = running(exons)
    for s, e, before in flat:
        if s <= pos < e:
            t = before + pos - s
            return max(length - 1 - t - max(size, 1) + 1, 0) if strand == "-" else t
    return None


def to_genome(read: dict, exons: list[tuple[int, int]], strand: str) -> dict | None:
    """A read on a transcript, on the genome; None when it doesn't fit. exons: (start, end) of the genome.

    On a minus transcript the read is turned round. Reference-consuming operations are cut at exon ends and
    an N bridges each intron; what would go past the last exon is left out.
    """
    flat, length = running(exons)
    ops = parse_cigar(read["cigar"])
    end = read["pos"] + sum(n for op, n in ops if op in "MDN=XP")
    if not ops or read["pos"] < 0 or end > length:
        return None
    out = dict(read)
    tpos = read["pos"]
    if strand == "-":
        ops, tpos = ops[::-1], length - end
        out |= {"flag": flipped(read["flag"]), "seq": read["seq"][::-1].translate(_SWAP), "qual": read["qual"][::-1], "md": reversed_md(read.get("md"))}
    at = _at(flat, tpos)
    if at is None:
        return None
    i, g = at
    out["pos"] = g
    made: list[tuple[str, int]] = []
    for op, n in ops:
        if op not in "MDP=X":
            made.append((op, n))
            continue
        while n:
            take = min(n, flat[i][1] - g)
            made.append((op, take))
            n, g = n - take, g + take
            if n:
                if i + 1 == len(flat):
                    break
                made.append(("N", flat[i + 1][0] - flat[i][1]))
                i, g = i + 1, flat[i + 1][0]
    return out | {"cigar": format_cigar(made)}


def to_transcript(read: dict, exons: list[tuple[int, int]], strand: str) -> dict | None:
    """A read on the genome, on a transcript; None when it doesn't fit.

    Stretches become stretches of the transcript, clipped (outside the exons, also within the read) or inserted;
    they are put together from 5' to 3', an N over left-out exon bases. A read with deletions must lie in
    exons with every matched and deleted base and may have no insertion.
    """
    flat, length = running(exons)
    minus = strand == "-"
    ops = parse_cigar(read["cigar"])
    deleted = any(op == "D" for op, _ in ops)
    g, runs = read["pos"], []  # (operation, bases, first transcript position or None)
    for op, n in ops:
        if op in "M=XD":
            i, at = max(0, bisect_right(flat, g, key=lambda x: x[0]) - 1), g
            while at < g + n:
                while i < len(flat) and flat[i][1] <= at:
                    i += 1
                s, e, before = flat[i] if i < len(flat) else (g + n, g + n, 0)
                stop = min(g + n, e if s <= at else s)
                if s <= at:
                    t = before + at - s
                    runs.append(("D" if op == "D" else "M", stop - at, length - t - (stop - at) if minus else t))
                elif deleted:
                    return None
                else:
                    runs.append(("S", stop - at, None))
                at = stop
            g += n
        elif op == "N":
            g += n
        elif op in "IS":
            if deleted and op == "I":
                return None
            runs.append((op, n, None))
        elif deleted and op != "P":
            return None
    if minus:
        runs.reverse()
    made, last = [], None
    for op, n, t in runs:
        if t is not None:
            if last is not None:
                if t <= last:
                    return None
                made.append(("N", t - last - 1))
            last = t + n - 1
        made.append((op, n))
    placed = [t for _, _, t in runs if t is not None]
    if not placed or sum(n for op, n in made if op in "MIS=X") != len(read["seq"]) or last + 1 > length:
        return None
    out = dict(read) | {"pos": placed[0], "cigar": format_cigar(made), "md": None}
    if minus:
        out |= {"flag": flipped(read["flag"]), "seq": read["seq"][::-1].translate(_SWAP), "qual": read["qual"][::-1]}
    return out


READ = "qname string, flag int, rname string, pos bigint, mapq int, cigar string, rnext string, pnext bigint, tlen bigint, seq string, qual string, tags map<string,string>, demoted boolean, ord bigint"


def _tags(tags, drop: tuple[str, ...], md: str | None) -> dict:
    kept = {k: v for k, v in (dict(tags) if tags is not None else {}).items() if k not in drop}
    if md is not None:
        kept["MD"] = f"Z:{md}"
    return kept


def lift_reads(reads: DataFrame, tx: DataFrame, to: str = "genome") -> DataFrame:
    """Reads (columns of READ without demoted, 0-based pos) lifted to the genome or to transcripts.

    To the genome a read finds its transcript by reference name; one that doesn't fit stays and is marked
    demoted (its flag is kept). To transcripts `tx` must be joined already as transcript_id; one that doesn't
    fit is dropped, and a mate on the same sequence is placed on the read's transcript, any other left out. The order
    of the reads is in `ord`.
    """
    if to == "genome":
        # of several transcripts of a name the first: by `ord` where tx has it, then by gene, sequence and strand
        first = [c for c in ("ord", "gene_id", "chrom", "strand") if c in tx.columns]
        spans = F.transform("exons", lambda e: F.struct(e["g_start"].alias("s"), e["g_end"].alias("e")))
        keyed = keyed_transcripts(tx).groupBy(F.col("key").alias("rname")).agg(F.min_by(F.struct(F.col("chrom").alias("t_chrom"), F.col("strand").alias("t_strand"), spans.alias("t_exons")), F.struct(*first)).alias("t")).select("rname", "t.*")
        joined = keyed_left_join(reads, keyed, "rname", ["ord"])
        mates = keyed.select(F.col("rname").alias("_mate"), F.col("t_chrom").alias("m_chrom"), F.col("t_strand").alias("m_strand"), F.col("t_exons").alias("m_exons"))
        joined = keyed_left_join(joined.withColumn("_mate", F.when(F.col("rnext") == "=", F.col("rname")).otherwise(F.col("rnext"))), mates, "_mate", ["ord"]).drop("_mate")
    else:
        joined = reads.join(tx.select("transcript_id", F.col("strand").alias("t_strand"), F.transform("exons", lambda e: F.struct(e["g_start"].alias("s"), e["g_end"].alias("e"))).alias("t_exons")), "transcript_id")
    names = [c.split()[0] for c in READ.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                exons = [(e["s"], e["e"]) for e in r["t_exons"]] if r.get("t_exons") is not None else None
                tags = dict(r["tags"]) if r["tags"] is not None else {}
                read = {k: r[k] for k in ("flag", "pos", "cigar", "seq", "qual")} | {"md": tags.get("MD", "")[2:] or None}
                drop = DROPPED_TO_GENOME if to == "genome" else DROPPED_TO_TRANSCRIPT
                got = (to_genome if to == "genome" else to_transcript)(read, exons, r["t_strand"]) if exons and not r["flag"] & 4 else None
                if got is None:
                    if to == "genome":
                        rows.append({**{k: r[k] for k in names if k in r}, "tags": tags, "demoted": True})
                    continue
                out = {**{k: r[k] for k in names if k in r}, **{k: got[k] for k in ("flag", "pos", "cigar", "seq", "qual")}, "tags": _tags(tags, drop, got["md"]), "demoted": False}
                out["rname"] = r["t_chrom"] if to == "genome" else r["transcript_id"]
                if to != "genome":
                    same = r["flag"] & 1 and r["rnext"] in ("=", r["rname"]) and r["pnext"] is not None and r["pnext"] >= 0
                    mate = mate_on_transcript(r["pnext"], len(r["seq"] or ""), exons, r["t_strand"]) if same else None
                    out |= {"rnext": "*", "pnext": -1} if mate is None else {"rnext": "=", "pnext": mate}
                if to == "genome" and r["flag"] & 1 and r.get("m_exons") is not None and r["pnext"] is not None:
                    flat, length = running([(e["s"], e["e"]) for e in r["m_exons"]])
                    p = r["pnext"]
                    if r["m_strand"] == "-":
                        size = sum(n for op, n in parse_cigar(r["cigar"]) if op in "MDN=X")
                        p = min(max(length - (p + size), 0), length - 1)
                    at = _at(flat, p)
                    if at:
                        out |= {"rnext": "=" if r["m_chrom"] == r["t_chrom"] else r["m_chrom"], "pnext": at[1]}
                rows.append(out)
            yield pd.DataFrame(rows, columns=names)

    return joined.mapInPandas(run, READ)
