"""Sequence windows around sites, and score matrices of motifs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.seq import mark_site, reverse_complement
from strandloom.operators.skew import keyed_left_join
from strandloom.sources.tables import fetch


def site_motifs(sites: DataFrame, chunks: DataFrame, lengths: DataFrame, record: str, left: int, right: int, chunk: int = 65536, wrap: bool = False) -> DataFrame:
    """sites (record, chrom, pos 1-based, strand) with `motif`: the bases from `left` before to `right` behind the site on
    the genome, N beyond the contig, turned round as a whole on the minus strand (where the site then has `right` before it).

    A position that isn't made of digits or a strand other than + and - ends the run with an error.
    """
    bad = sites.where(~F.coalesce(F.col("pos").cast("string").rlike("^[0-9]+\\z"), F.lit(False)) | ~F.coalesce(F.col("strand").isin("+", "-"), F.lit(False)))
    if bad.limit(1).count():
        raise ValueError("rows with an invalid position or strand")
    p = F.col("pos").cast("bigint") - 1
    placed = sites.withColumn("_a", p - left).withColumn("_b", p + 1 + right)
    at = keyed_left_join(placed, lengths.select("chrom", F.col("length").alias("_len")), "chrom", [record])
    got = fetch(chunks, at, record, "_a", "_b", chunk)
    n = lambda k: F.call_function("repeat", F.lit("N"), F.greatest(k, F.lit(0)).cast("int"))
    size = F.lit(left + right + 1)
    before = F.least(F.greatest(-F.col("_a"), F.lit(0)), size)
    whole = F.concat(n(before), F.col("seq"), n(size - before - F.length("seq")))
    motif = F.upper(F.when(F.col("strand") == "-", reverse_complement(whole)).otherwise(whole))
    out = got.withColumn("motif", motif).drop("_a", "_b", "_len", "seq")
    return out.withColumn("motif", mark_site(F.col("motif"), F.col("strand"), left, right)) if wrap else out


def motif_scores(motifs: DataFrame, rna: bool = True, bits: bool = False, share: bool = False) -> DataFrame:
    """(position, base, score, rank) of motifs (idx, motif, weight) of one length: weighted counts per position,
    the weights taken from the smallest on (so equal weights give zeros); a null weight is 0.

    bits scales each position by its information, (2 + sum p log2 p) / N with p = count / N; share divides by
    the sum of weights. Bases rank by count, then by the first motif that has them.
    """
    s = F.upper("motif")
    rows = motifs.select("idx", (F.translate(s, "T", "U") if rna else s).alias("motif"), F.nanvl(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("w"))
    facts = rows.agg(F.min(F.length("motif")).alias("a"), F.max(F.length("motif")).alias("b"), F.min("w").alias("least"), F.sum("w").alias("sum"), F.count("*").alias("n")).first()
    if facts["a"] != facts["b"]:
        raise ValueError("motifs of different lengths")
    n, total = facts["n"], (facts["sum"] or 0.0) - (facts["least"] or 0.0) * facts["n"]
    each = rows.select("idx", (F.col("w") - F.lit(facts["least"] or 0.0)).alias("w"), F.posexplode(F.split("motif", "")).alias("position", "base")).where("base <> ''")
    counts = each.groupBy("position", "base").agg(F.sum("w").alias("score"), F.min("idx").alias("first"))
    if bits:
        p = F.col("score") / n
        info = counts.groupBy("position").agg(((F.lit(2.0) + F.sum(F.when(p > 0, p * F.log2(p)).otherwise(0.0))) / n).alias("info"))
        counts = counts.join(info, "position")
    w = Window.partitionBy("position").orderBy(F.desc("score"), "first")
    ranked = counts.withColumn("rank", F.row_number().over(w))
    score = F.col("score") * F.col("info") if bits else (F.col("score") / total if total else F.lit(0.0)) if share else F.col("score")
    return ranked.select("position", "base", score.alias("score"), "rank")


def score_matrix(scores: DataFrame) -> DataFrame:
    """One row per position with a column per base, A C G T U first, 0 where a base doesn't occur."""
    fixed = ["A", "C", "G", "T", "U"]
    more = [r["base"] for r in scores.select("base").distinct().where(~F.col("base").isin(fixed)).orderBy("base").collect()]  # letters
    return scores.groupBy("position").pivot("base", fixed + more).agg(F.first("score")).fillna(0.0)


def rename_chromosomes(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """The column by the mapping (old, new); a name that isn't there stays."""
    return keyed_left_join(df, names.select(F.col("old").alias(column), "new"), column, [c for c in df.columns if c != column] or [column]).withColumn(column, F.coalesce("new", column)).drop("new")
