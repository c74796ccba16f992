"""Sites on transcripts, and their density over regions and around points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.intervals import best_overlap, nearest_in, overlap_join, overlap_pairs
from strandloom.plans.reference import best_transcripts, reference_points
from strandloom.runtime import cut

ANNOTATED = ("gene_id", "transcript_id", "transcript_start", "transcript_end", "transcript_length", "start_codon_pos", "stop_codon_pos")


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.least(x, high), low)


def map_to_transcripts(sites: DataFrame, exons: DataFrame, record: str = "record_id") -> DataFrame:
    """Every site, with each exon of a gene's best transcript that it overlaps on its strand; a site in none has nulls.

    sites: record, chrom, start, end, strand; other columns that clash with the annotation are dropped.
    """
    best = exons.join(best_transcripts(exons).select("transcript_id").distinct(), "transcript_id", "left_semi")
    right = best.select("chrom", "strand", "e_start", "e_end", "start_offset", "end_offset", "gene_id", "transcript_id", "transcript_length", "start_codon_pos", "stop_codon_pos")
    left = sites.drop(*(set(right.columns) - {"chrom", "strand"}))
    hit = overlap_join(left, right, ["chrom", "strand"], ("start", "end"), ("e_start", "e_end"), record, "left")
    zero, span = F.lit(0), F.col("end_offset") - F.col("start_offset")
    minus = F.col("strand") == "-"
    a = F.when(minus, F.col("e_end") - F.col("end")).otherwise(F.col("start") - F.col("e_start"))
    b = F.when(minus, F.col("e_end") - F.col("start")).otherwise(F.col("end") - F.col("e_start"))
    return hit.withColumn("transcript_start", clamp(a, zero, span) + F.col("start_offset")).withColumn("transcript_end", clamp(b, zero, span) + F.col("start_offset")).drop("e_start", "e_end", "start_offset", "end_offset")


def middle(start: Column, end: Column) -> Column:
    return F.floor((start + end) / 2)


def region(pos: Column, start_codon: Column, stop_codon: Column) -> Column:
    """5UTR, CDS (the stop codon is part of it) or 3UTR; None where the position or a codon is unknown."""
    known = pos.isNotNull() & start_codon.isNotNull() & stop_codon.isNotNull()
    return F.when(~known, "None").when(pos < start_codon, "5UTR").when(pos >= stop_codon + 3, "3UTR").otherwise("CDS")


def region_counts(annotated: DataFrame) -> DataFrame:
    return annotated.withColumn("feature_type", region(middle(F.col("transcript_start"), F.col("transcript_end")), F.col("start_codon_pos"), F.col("stop_codon_pos"))).groupBy("feature_type").agg(F.sum(F.lit(1.0)).alias("count"))


def gene_splits(annotated: DataFrame, strategy: str = "median") -> tuple[float, float, float]:
    """The shares of 5'UTR, CDS and 3'UTR over the distinct transcripts hit, by exact median or mean of their lengths. One row comes to the driver."""
    if strategy not in ("median", "mean"):
        raise ValueError(f"unknown strategy {strategy!r}")
    tx = annotated.select("transcript_id", "transcript_length", "start_codon_pos", "stop_codon_pos").dropna().dropDuplicates()
    f = F.avg if strategy == "mean" else lambda c: F.percentile(c, 0.5)
    r = tx.agg(f(F.col("start_codon_pos")).alias("a"), f(F.col("stop_codon_pos") + 3 - F.col("start_codon_pos")).alias("b"), f(F.col("transcript_length") - F.col("stop_codon_pos") - 3).alias("c")).first()
    parts = [float(x or 0) for x in r]
    total = sum(parts)
    return tuple(x / total for x in parts) if total else (0.0, 0.0, 0.0)


def uniform_edges(bins: int) -> list[float]:
    return [i / bins for i in range(bins)] + [1.0]


def region_edges(splits: Sequence[float], bins: int) -> list[float]:
    """Bin edges that meet the region borders; each region has round(share * bins) bins, one at least."""
    if not any(splits):
        return uniform_edges(bins)
    borders = sorted({0.0, splits[0], min(1.0, splits[0] + splits[1]), 1.0})
    edges = [0.0]
    for a, b in zip(borders, borders[1:], strict=False):
        n = max(1, round((b - a) * bins))
        edges += [a + (b - a) * i / n for i in range(1, n)] + [b]
    return [e for i, e in enumerate(edges) if i == 0 or e > edges[i - 1]]


def feature_position(pos: Column, splits: Sequence[float], length: Column, start_codon: Column, stop_codon: Column) -> Column:
    """The place of a transcript position in the profile from 0 to 1; null outside known regions."""
    s0, s1, s2 = map(float, splits)
    kind = region(pos, start_codon, stop_codon)
    one = lambda x: F.greatest(x, F.lit(1))
    return (
        F.when(kind == "5UTR", pos / one(start_codon) * s0)
        .when(kind == "CDS", s0 + (pos - start_codon) / one(stop_codon + 3 - start_codon) * s1)
        .when(kind == "3UTR", s0 + s1 + (pos - stop_codon - 3) / one(length - stop_codon - 3) * s2)
    )


def histogram(df: DataFrame, x: str, edges: Sequence[float], weights: Sequence[str] = ()) -> DataFrame:
    """(bin, feature_midpoint, count | count_w, mean_w): every bin [a, b), the last closed; values outside are dropped.

    The edges are literals, so that a value meets exactly the given numbers; a weight that isn't a number is 0.
    """
    n = len(edges) - 1

    def place(low: int, high: int) -> Column:
        """The number of the bin by halving, so that a row meets as many comparisons as the bins have bits."""
        if high - low == 1:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(x) >= float(edges[mid]), place(mid, high)).otherwise(place(low, mid))

    at = F.when((F.col(x) >= float(edges[0])) & (F.col(x) <= float(edges[-1])), place(0, n))
    w = {c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in weights}
    aggs = [F.sum(F.lit(1.0)).alias("_n"), *[F.sum(v).alias(f"_s{i}") for i, v in enumerate(w.values())]]
    got = df.withColumn("bin", at).where("bin is not null").groupBy("bin").agg(*aggs)
    bins = df.sparkSession.createDataFrame([(i, (edges[i] + edges[i + 1]) / 2) for i in range(n)], "bin int, feature_midpoint double")
    out = bins.join(got, "bin", "left").withColumn("_n", F.coalesce("_n", F.lit(0.0)))
    if not weights:
        return out.select("bin", "feature_midpoint", F.col("_n").alias("count"))
    cols = []
    for i, c in enumerate(weights):
        s = F.coalesce(F.col(f"_s{i}"), F.lit(0.0))
        cols += [s.alias(f"count_{c}"), F.when(F.col("_n") > 0, s / F.col("_n")).otherwise(0.0).alias(f"mean_{c}")]
    return out.select("bin", "feature_midpoint", *cols)


def rolling_mean(profile: DataFrame, column: str, k: int, order: str = "bin") -> DataFrame:
    """The centred mean over k bins; null where the window leaves the profile. A profile has some hundred rows."""
    before = k // 2
    w = Window.orderBy(order).rowsBetween(-before, k - before - 1)
    return profile.withColumn(column, F.when(F.count(F.lit(1)).over(w) == k, F.avg(column).over(w)))


def weights(df: DataFrame, column: str, normalise: bool = False, log: str | None = None) -> DataFrame:
    """A weight column as numbers, perhaps divided by the transcript's length and in logarithm; log of 0 is -inf, of less NaN."""
    v = F.col(column).try_cast("double")
    v = v / F.col("transcript_length") if normalise else v
    if log:
        f = {"log2": F.log2, "log10": F.log10}[log]
        v = F.when(v == 0, float("-inf")).when(v < 0, float("nan")).otherwise(f(v))
    return df.withColumn(column, v)


def metagene(sites: DataFrame, exons: DataFrame, bins: int = 100, strategy: str = "median", weight: Sequence[str] = (), only: str | None = None, smooth: int = 1) -> DataFrame:
    """The profile of sites over 5'UTR, CDS and 3'UTR. `only` keeps one region; the shares still come from all sites."""
    annotated = cut(map_to_transcripts(sites, exons))
    splits = gene_splits(annotated, strategy)
    pos = middle(F.col("transcript_start"), F.col("transcript_end"))
    kept = annotated.where(region(pos, F.col("start_codon_pos"), F.col("stop_codon_pos")) == only) if only else annotated
    placed = kept.withColumn("feature_pos", feature_position(pos, splits, F.col("transcript_length"), F.col("start_codon_pos"), F.col("stop_codon_pos")))
    out = histogram(placed, "feature_pos", region_edges(splits, bins), weight)
    kind = F.when(F.col("feature_midpoint") < splits[0], "5UTR").when(F.col("feature_midpoint") > splits[0] + splits[1], "3UTR").otherwise("CDS")
    for c in [c for c in out.columns if c.startswith(("count", "mean"))] if smooth > 1 else []:
        out = rolling_mean(out, c, smooth)
    return out.withColumn("feature_type", kind)


def with_distance(annotated: DataFrame, exons: DataFrame, point: str) -> DataFrame:
    """Annotated sites with `distance` to their transcript's point; sites without one are left out."""
    pos = middle(F.col("transcript_start"), F.col("transcript_end"))
    points = reference_points(exons, point)
    joined = annotated.where("transcript_id is not null").join(points, "transcript_id").withColumn("_pos", pos)
    ref = nearest_in(F.col("ref_pos"), F.col("_pos")) if point == "junction" else F.col("ref_pos")
    return joined.withColumn("distance", F.col("_pos") - ref).where("distance is not null").drop("_pos", "ref_pos")


def metagene_point(sites: DataFrame, exons: DataFrame, point: str, before: int = 1000, after: int = 1000, bins: int = 100, weight: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """The profile around a point, and how many sites lay outside its span (sites without a point aren't counted)."""
    best = exons.join(best_transcripts(exons).select("transcript_id").distinct(), "transcript_id", "left_semi")
    at = cut(with_distance(map_to_transcripts(sites, exons), best, point))
    near = at.where(F.col("distance").between(-before, after))
    out = histogram(near.withColumn("feature_pos", (F.col("distance") + before) / float(before + after)), "feature_pos", uniform_edges(bins), weight)
    return out.withColumn("distance_bp", F.col("feature_midpoint") * (before + after) - before), at.count() - near.count()


def map_to_local(query: DataFrame, reference: DataFrame, ref_id: str, record: str, match_by: str | None = None) -> DataFrame:
    """Genome intervals in coordinates of the reference (one or more blocks per ref_id, 5' to 3'); misses are dropped.

    query and reference have chrom, start, end, strand (those of the reference with the prefix r_). The
    strand of the result is + when both strands agree.
    """
    plus = F.col("r_strand") == "+"
    w = Window.partitionBy(ref_id).orderBy(F.when(plus, F.col("r_start")).otherwise(-F.col("r_start")), "r_end").rowsBetween(Window.unboundedPreceding, -1)
    placed = reference.where("r_start is not null and r_end is not null").withColumn("_off", F.coalesce(F.sum(F.col("r_end") - F.col("r_start")).over(w), F.lit(0)))
    keys = ["chrom", *([match_by] if match_by else [])]
    hit = overlap_pairs(query, placed, keys, ("start", "end"), ("r_start", "r_end"), [record])
    a, b = F.greatest("start", "r_start"), F.least("end", "r_end")
    minus = F.col("r_strand") == "-"
    start = F.when(minus, F.col("r_end") - b).otherwise(a - F.col("r_start")) + F.col("_off")
    end = F.when(minus, F.col("r_end") - a).otherwise(b - F.col("r_start")) + F.col("_off")
    out = hit.withColumn("local_start", start).withColumn("local_end", end).withColumn("local_strand", F.when(F.col("strand") == F.col("r_strand"), "+").otherwise("-"))
    return out.drop("_off")


def bin_statistics(df: DataFrame, x: str, weight: str, bins: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(bin, count, sum, mean) over equal bins from low to high; the upper border belongs to the last bin."""
    width = (high - low) / bins
    at = F.least(F.floor((F.col(x) - low) / width), F.lit(bins - 1))
    got = df.where(F.col(x).between(low, high)).withColumn("bin", at.cast("int")).groupBy("bin").agg(F.count("*").alias("count"), F.sum(weight).alias("sum"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(got, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("sum", F.lit(0.0)).alias("sum"), F.when(F.col("count") > 0, F.col("sum") / F.col("count")).otherwise(0.0).alias("mean"))


def region_ratios(features: DataFrame) -> DataFrame:
    """(type, ratio): the median over transcripts of each type's summed window length, scaled to 1."""
    sums = features.groupBy("transcript", "type").agg(F.sum("len_of_window").alias("n")).groupBy("type").agg(F.percentile("n", 0.5).alias("m"))
    return sums.withColumn("ratio", F.col("m") / F.sum("m").over(Window.partitionBy(F.lit(0)))).drop("m")  # one row per type


def annotate_with_features(df: DataFrame, features: DataFrame, record: str, stranded: bool = False) -> DataFrame:
    """Each interval with the feature it overlaps most, and the place of its middle in that feature."""
    keys = ["chrom", "strand"] if stranded else ["chrom"]
    right = features.select(*keys, "f_start", "f_end", "feature_idx", "transcript", "type", *(["f_strand"] if not stranded else []))
    best = best_overlap(df, right, keys, ("start", "end"), ("f_start", "f_end"), record, ["feature_idx"])
    mid = clamp((F.col("start") + F.col("end")) / 2.0, F.col("f_start").cast("double"), F.col("f_end").cast("double"))
    strand = F.col("strand") if stranded else F.col("f_strand")
    size = F.col("f_end") - F.col("f_start")
    return best.withColumn("relative", F.when(strand == "-", F.col("f_end") - mid).otherwise(mid - F.col("f_start")) / size)


def summary(df: DataFrame) -> DataFrame:
    """Counts by feature type with mean, median, least and greatest feature_pos."""
    return df.groupBy("feature_type").agg(F.count("*").alias("n"), F.avg("feature_pos").alias("mean"), F.percentile("feature_pos", 0.5).alias("median"), F.min("feature_pos").alias("least"), F.max("feature_pos").alias("greatest"))
