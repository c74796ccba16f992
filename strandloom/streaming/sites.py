"""Streams of sites against a static exon reference, and windowed region counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.plans.annotate import region
from strandloom.runtime import cut


def exon_cells(exons: DataFrame, width: int = 1 << 14) -> DataFrame:
    """Exons by the cells of `width` bases they touch; written once, so that each micro-batch reads the table."""
    return cut(exons.withColumn("_cell", F.explode(F.sequence((F.col("e_start") / width).cast("long"), ((F.col("e_end") - 1) / width).cast("long")))))


def locate(stream: DataFrame, cells: DataFrame, width: int = 1 << 14) -> DataFrame:
    """A stream of sites (chrom, pos 1-based, strand, ...) joined to the exons that hold them, with transcript_pos and region."""
    p = F.col("pos") - 1
    right = cells.select(F.col("chrom").alias("_c"), F.col("strand").alias("_s"), "_cell", "e_start", "e_end", "start_offset", "gene_id", "transcript_id", "start_codon_pos", "stop_codon_pos")
    left = stream.withColumn("_at", (p / width).cast("long"))
    hit = left.join(right, (F.col("chrom") == F.col("_c")) & (F.col("strand") == F.col("_s")) & (F.col("_at") == F.col("_cell")) & (F.col("e_start") <= p) & (p < F.col("e_end")))
    t = F.when(F.col("strand") == "-", F.col("e_end") - 1 - p).otherwise(p - F.col("e_start")) + F.col("start_offset")
    return hit.withColumn("transcript_pos", t).withColumn("region", region(t, F.col("start_codon_pos"), F.col("stop_codon_pos"))).drop("_c", "_s", "_cell", "_at", "e_start", "e_end", "start_offset")


def region_windows(located: DataFrame, time: str, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Counts by event-time window and region; what comes later than `late` is dropped by the watermark, as declared."""
    return located.withWatermark(time, late).groupBy(F.window(time, window), "region").agg(F.count("*").alias("sites"))
