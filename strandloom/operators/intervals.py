"""Joins on overlapping intervals, as equi-joins on hierarchical bins, and what builds on them.

Intervals are 0-based and half-open. Each interval of the right side lies in one or two bins of the smallest
level whose bins are at least as wide as it; a row of the left side looks into its bins on each level that
occurs. So neither long nor short intervals multiply rows, and a chromosome is spread over many keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.skew import keyed_left_join
from strandloom.runtime import fits, measured

#: Bin widths are 2 ** (10 + 3 * level).
LOWEST, STEP, LEVELS = 10, 3, 9


def _level(length: Column) -> Column:
    """The smallest level whose bins are at least `length` wide; the last level takes all beyond."""
    out = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        out = F.when(length <= 1 << (LOWEST + STEP * k), k).otherwise(out)
    return out


def _bits(level: Column) -> Column:
    return level * STEP + LOWEST


def overlap_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[str, str | None], right_span: tuple[str, str], spread: Sequence[str]) -> DataFrame:
    """All pairs of rows with equal `keys` whose spans overlap: left.start < right.end and right.start < left.end.

    left_span's end may be None: the left rows are points [start, start + 1). Null keys, null spans and
    empty spans join nothing; repeated rows join as often as they occur. Other columns of the two sides must
    not share names. `spread` are left columns that tell rows of a hot bin apart.
    """
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash:
        raise ValueError(f"both sides have the columns {sorted(clash)}")
    ls, rs, re = F.col(left_span[0]), F.col(right_span[0]), F.col(right_span[1])
    le = F.col(left_span[1]) if left_span[1] else ls + 1
    placed = right.where((rs < re) & rs.isNotNull()).withColumn("_level", _level(re - rs))
    right_keys = [F.col(k) for k in keys]
    shift = lambda c, bits: F.shiftright(c.cast("long"), bits)

    def binned(level_bits: Column, start: Column, end: Column) -> Column:
        return F.sequence(F.call_function("shiftright", start.cast("long"), level_bits.cast("int")), F.call_function("shiftright", (end - 1).cast("long"), level_bits.cast("int")))

    name = lambda level, bin_: F.concat_ws("\x1f", *[k.cast("string") for k in right_keys], level.cast("string"), bin_.cast("string"))
    no_null = F.lit(True)
    for k in right_keys:
        no_null = no_null & k.isNotNull()
    many = placed.where(no_null).withColumn("_bin", F.explode(binned(_bits(F.col("_level")), rs, re)))
    # one job writes it and tells its size and the levels that occur
    many, facts = measured(many.withColumn("_cell", name(F.col("_level"), F.col("_bin"))).drop("_bin", *keys), levels=F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("_level"))))
    levels = [k for k in range(LEVELS) if (facts["levels"] or 0) >> k & 1]
    many = many.drop("_level")

    def cells(k: int) -> Column:
        return F.transform(F.sequence(shift(ls, LOWEST + STEP * k), shift(le - 1, LOWEST + STEP * k)), lambda b: F.struct(F.lit(k).alias("level"), b.alias("bin")))

    looks = F.concat(*map(cells, levels)) if levels else F.array().cast("array<struct<level:int,bin:bigint>>")
    looking = left.where(no_null & (ls < le) & ls.isNotNull()).withColumn("_look", F.explode(looks)).withColumn("_cell", name(F.col("_look.level"), F.col("_look.bin")))
    joined = keyed_left_join(looking, many, "_cell", list(spread), "inner", fits(facts))
    hits = joined.where((ls < re) & (rs < le))
    if left_span[1]:
        # a pair meets in several bins: it counts in the first they share
        bits = _bits(F.col("_look.level")).cast("int")
        first = F.greatest(F.call_function("shiftright", ls.cast("long"), bits), F.call_function("shiftright", rs.cast("long"), bits))
        hits = hits.where(F.col("_look.bin") == first)
    return hits.drop("_look", "_cell")


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[str, str | None], right_span: tuple[str, str], record: str, how: str = "inner") -> DataFrame:
    """As overlap_pairs; how=left also keeps the left rows without partner, with nulls. `record` is unique on the left."""
    if how == "inner":
        return overlap_pairs(left, right, keys, left_span, right_span, [record])
    pairs = overlap_pairs(left.select(record, *keys, *[c for c in left_span if c]), right, keys, left_span, right_span, [record])
    return left.join(pairs.drop(*keys, *[c for c in left_span if c]), record, "left")


def first_by(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in the given order; the order should be total."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rank = 1").drop("_rank")


def best_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str], record: str, tie: Sequence[str]) -> DataFrame:
    """For each left row the right row it overlaps most; ties go to the smallest `tie` columns."""
    pairs = overlap_pairs(left, right, keys, left_span, right_span, [record])
    size = F.least(left_span[1], right_span[1]) - F.greatest(left_span[0], right_span[0])
    others = [c for c in pairs.columns if c != record]
    return pairs.withColumn("overlap", size).groupBy(record).agg(F.min_by(F.struct(*others, "overlap"), F.struct(-F.col("overlap"), *tie)).alias("b")).select(record, "b.*")


def merge_intervals(df: DataFrame, by: Sequence[str], start: str, end: str, touch: int = 0) -> DataFrame:
    """The unions of overlapping intervals per group; those at most `touch` apart are merged too. Empty and null ones are dropped."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.where(F.col(start) < F.col(end)).select(*by, start, end).withColumn("_new", F.when(F.col(start) > reach + touch, 1).otherwise(0))
    return rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def depth_steps(df: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """(by, seg_start, seg_end, depth): how many intervals cover each stretch of positions, stretches of depth 0 left out."""
    events = df.where(F.col(start) < F.col(end)).select(*by, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("e")).groupBy(*by, F.col("e.at").alias("seg_start")).agg(F.sum("e.d").alias("_d"))
    w = Window.partitionBy(*by).orderBy("seg_start")
    steps = events.withColumn("depth", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("seg_end", F.lead("seg_start").over(w))
    return steps.where("depth > 0").select(*by, "seg_start", "seg_end", "depth")


def nearest_in(sorted_points: Column, x: Column) -> Column:
    """The element of an ascending array that is nearest to x; of two as near, the lower. Null for an empty array."""
    lower, upper = F.array_max(F.filter(sorted_points, lambda p: p < x)), F.array_min(F.filter(sorted_points, lambda p: p >= x))
    return F.when(lower.isNull(), upper).when(upper.isNull(), lower).when(x - lower <= upper - x, lower).otherwise(upper)
